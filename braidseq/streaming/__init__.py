"""No streaming operators: the blueprint lists none, all inputs are read whole."""
