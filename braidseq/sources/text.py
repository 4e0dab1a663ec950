"""Readers and writers of the text formats: sequence blocks, model blocks, nested configs, genomes."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.models import Model

#: Most symbols of a sequence and most sequences of a block.
MAX_LENGTH, MAX_ROWS = 100_000, 1_500_000

_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"|[{}=;,]|\([^)]*\)|<[^>]*>|\|[^|]*\||[^\s{}=;,()<>|"]+')


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(re.sub(r"#[^\n]*", "", text))


class _Reader:
    """Tokens in turn."""

    def __init__(self, text: str):
        self.t, self.i = tokens(text), 0

    def peek(self) -> str:
        return self.t[self.i] if self.i < len(self.t) else ""

    def next(self, want: str | None = None) -> str:
        x = self.peek()
        if want is not None and x != want:
            raise ValueError(f"expected {want!r}, found {x!r}")
        self.i += 1
        return x

    def rows(self) -> list[tuple[dict, list[float]]]:
        """Rows of numbers that end in semicolons, with their marks, up to the closing brace."""
        out = []
        self.next("{")
        while self.peek() != "}":
            marks, numbers = {}, []
            while self.peek() != ";":
                x = self.next()
                if x == "":
                    raise ValueError("a row does not end")
                if x[0] in "(<|":
                    marks[x[0]] = float(x[1:-1])
                elif x != ",":
                    numbers.append(float(x))
            self.next(";")
            out.append((marks, numbers))
        self.next("}")
        return out


def parse_sequences(text: str) -> list[tuple[str, int, dict, list[float]]]:
    """(block kind, block number, marks, numbers) of every row of the SEQ and SEQD blocks."""
    r, out, block = _Reader(text), [], 0
    while r.peek():
        kind = r.next()
        if kind not in ("SEQ", "SEQD"):
            continue
        r.next("=")
        r.next("{")
        while r.peek() != "}":
            key = r.next()
            r.next("=")
            if key == "O":
                rows = r.rows()
                if len(rows) > MAX_ROWS:
                    raise ValueError("too many sequences")
                for marks, numbers in rows:
                    if len(numbers) > MAX_LENGTH or marks.get("|", 1) <= 0:
                        raise ValueError("a sequence is too long or has no weight")
                    out.append((kind, block, marks, numbers))
            elif key == "L" and kind == "SEQ":
                spec = r.next("{") and {}
                while r.peek() != "}":
                    name = r.next()
                    r.next("=")
                    spec[name] = int(r.next())
                    r.next(";")
                r.next("}")
                n, m = spec["seq_len"], spec["symb"]
                out += [(kind, block, {}, [float(i // m ** (n - 1 - j) % m) for j in range(n)]) for i in range(m**n)]
            else:
                raise ValueError(f"unknown key {key!r}")
            if r.peek() == ";":
                r.next()
        r.next("}")
        block += 1
    return out


SEQUENCES = "path string, kind string, block int, seq_id long, label long, weight double, obs array<double>"


def read_sequences(spark: SparkSession, path: str, symbols: bool = False) -> DataFrame:
    """Sequences of all files under path; one file is one task. symbols: obs as ints."""

    def run(frames):
        for frame in frames:
            for p, text in zip(frame["path"], frame["value"]):
                rows = [(p, k, b, int(m.get("(", i)), int(m["<"]) if "<" in m else None, m.get("|", 1.0), n) for i, (k, b, m, n) in enumerate(parse_sequences(text))]
                yield pd.DataFrame(rows, columns=["path", "kind", "block", "seq_id", "label", "weight", "obs"]).astype({"label": "Int64"})

    got = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value").mapInPandas(run, SEQUENCES)
    return got.withColumn("obs", F.col("obs").cast("array<int>")) if symbols else got


def sequence_lines(seqs: DataFrame, decimals: int | None = None) -> DataFrame:
    """value: a line per sequence, as the readers take it."""
    number = (lambda x: F.format_number(x, decimals)) if decimals is not None else (lambda x: x.cast("string"))
    numbers = F.regexp_replace(F.concat_ws(";", F.transform("obs", number)), ",", "")
    label = F.coalesce(F.col("label"), F.lit(-1)) if "label" in seqs.columns else F.lit(-1)
    return seqs.select(F.concat(F.lit("\t("), F.col("seq_id").cast("string"), F.lit(")\t<"), label.cast("string"), F.lit(">\t|"), F.col("weight").cast("string"), F.lit("|\t"), F.regexp_replace(numbers, ";", ", "), F.lit(";")).alias("value"))


def write_sequences(seqs: DataFrame, path: str, kind: str = "SEQ", decimals: int | None = None) -> None:
    """Part files, each a whole block of its own, so that they read back alone or together."""

    def run(frames):
        lines = [x for frame in frames for x in frame["value"]]
        if lines:
            yield pd.DataFrame({"value": [f"{kind} = {{\n\tO = {{\n" + "\n".join(lines) + "\n\t};\n};"]})

    sequence_lines(seqs, decimals).mapInPandas(run, "value string").write.mode("overwrite").text(path)


def _listed(items, pattern: str, between: str):
    return F.array_join(F.transform(items, lambda x: F.format_string(pattern, x)), between)


def gnu_text(decimals: int = 8):
    """A sequence for plotting: a value to a line, and two empty lines after the last."""
    return F.concat(_listed("obs", f"%.{decimals}f\n", ""), F.lit("\n\n"))


def mathematica_text(pattern: str = "%d"):
    """A sequence as a list in braces."""
    return F.concat(F.lit("{"), _listed("obs", pattern, ", "), F.lit("}"))


def xml_text(pattern: str = "%f"):
    """A sequence as an XML element with its weight in front, its identifier and length, and its label if it has one."""
    label = F.coalesce(F.concat(F.lit("<Label>"), F.col("label").cast("string"), F.lit("</Label>")), F.lit(""))
    head = F.concat(F.format_string("  %.0f <Sequence id=\"seq%d\">", "weight", "seq_id"), label, F.format_string("<!-- Length: %d --> ", F.size("obs")))
    return F.concat(head, _listed("obs", pattern, " "), F.lit("  </Sequence>"))


def write_xml(seqs: DataFrame, path: str, pattern: str = "%f") -> None:
    """Part files, each a whole document of sequences. A null label is left out."""
    seqs = seqs if "label" in seqs.columns else seqs.withColumn("label", F.lit(None).cast("long"))
    head, tail = '<Sequences type="int" >\n <DiscretePD>', " </DiscretePD>\n</Sequences>"
    _whole(seqs.select(xml_text(pattern).alias("value")), head, "", tail).write.mode("overwrite").text(path)


def write_mathematica(seqs: DataFrame, path: str, name: str = "Seq", pattern: str = "%d") -> None:
    """Part files, each a list of lists that is assigned to `name`."""
    _whole(seqs.select(mathematica_text(pattern).alias("value")), f"{name} = {{", ",", "};").write.mode("overwrite").text(path)


def write_gnu(seqs: DataFrame, path: str, decimals: int = 8) -> None:
    lines = gnu_text(decimals)  # the writer adds the last line break
    seqs.select(F.substring(lines, F.lit(1), F.char_length(lines) - 1).alias("value")).write.mode("overwrite").text(path)


def _whole(lines: DataFrame, head: str, between: str, tail: str) -> DataFrame:
    """The lines of each partition with a head and a tail of their own; `between` ends every line but the last. No partition is held as a whole."""

    def run(frames):
        last = None
        for frame in frames:
            values = frame["value"].tolist()
            if values:
                yield pd.DataFrame({"value": [head if last is None else last + between, *[v + between for v in values[:-1]]]})
                last = values[-1]
        if last is not None:
            yield pd.DataFrame({"value": [last, tail]})

    return lines.mapInPandas(run, "value string")


def letters(spark: SparkSession, path: str) -> DataFrame:
    """seq_id, seq: every run of letters of the text files under path, in lower case."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]+"), F.lit(0))).alias("seq_id", "seq"))
    return lines


def parse_config(text: str, folder: Path | None = None):
    """Nested lists of a config: {name: value} where all items have names, else a list."""
    r = _Reader(text)

    def value():
        x = r.next()
        if x == "{":
            return items("}")
        if x[:1] == '"':
            return re.sub(r"\\(.)", r"\1", x[1:-1])
        return float(x)

    def items(end):
        named, plain = {}, []
        while r.peek() != end:
            if r.peek() == "":
                raise ValueError("a list does not end")
            if r.peek() == "@include":
                r.next()
                name = r.next()[1:-1]
                if folder is None:
                    raise ValueError("an include needs the folder of its file")
                inner = parse_config((folder / name).read_text(), folder)
                named.update(inner) if isinstance(inner, dict) else plain.extend(inner)
            elif r.i + 1 < len(r.t) and r.t[r.i + 1] == "=" and r.peek() not in "{}":
                name = r.next()
                r.next("=")
                named[name] = value()
            else:
                plain.append(value())
            if r.peek() == ",":
                r.next()
        if end:
            r.next(end)
        return named if named else plain

    return items("")


def model_of_config(config: dict) -> Model:
    """A model from symbols and states [name, emit, outputs [index from 1, prob]]; a state without emissions is silent."""
    states = config["states"]
    a, b = np.zeros((len(states), len(states))), np.zeros((len(states), len(config["symbols"])))
    for i, s in enumerate(states):
        b[i] = s.get("emit") or 0
        for o in s.get("outputs") or []:
            a[i, int(o["index"]) - 1] = o["prob"]
    return Model.of(np.eye(len(states))[0], a, b, names=tuple(s["name"] for s in states)).normalized()


def config_of_model(m: Model, symbols=("A", "C", "G", "T")) -> str:
    """Text that model_of_config reads, with the edges above 0 and five decimals."""
    out = ["symbols={ " + " ".join(f'"{s}"' for s in symbols) + " }", "states={"]
    for i in range(m.n):
        edges = "\n".join(f"\t\t {{ index={j + 1} prob={m.a[0, i, j]:.5f} }}" for j in np.flatnonzero(m.a[0, i]))
        out.append(f'\t{{\n\t\tname="{m.names[i]}"\n\t\temit={{ ' + " ".join(f"{p:.5f}" for p in m.b[i]) + f" }}\n\t\toutputs={{\n{edges}\n\t\t}}\n\t}}")
    return "\n".join([*out, "}"])


def parse_models(text: str) -> list[Model]:
    """Models of the HMM and SHMM blocks; multip gives copies."""
    r, out = _Reader(text), []
    while r.peek():
        kind = r.next()
        if kind not in ("HMM", "SHMM"):
            continue
        r.next("=")
        r.next("{")
        f = {}
        while r.peek() != "}":
            key = r.next()
            r.next("=")
            if r.peek() in ("matrix", "vector"):
                r.next()
                f[key] = [n for _, n in r.rows()]
            else:
                f[key] = r.next()
            r.next(";")
        r.next("}")
        if r.peek() == ";":
            r.next()
        prior = float(f.get("prior", 1))
        shared = {"prior": prior if prior > 0 else 1.0, "fixed": tuple(bool(x) for x in f["fix_state"][0]) if "fix_state" in f else ()}
        a = np.array([f[k] for k in sorted((k for k in f if re.fullmatch(r"Ak_\d+", k)), key=lambda k: int(k[3:]))] or [f["A"]] * int(f.get("cos", 1)))
        if kind == "HMM":
            m = Model.of(f["Pi"][0], a, f["B"], **shared)
        else:
            m = Model.of(f["Pi"][0], a, c=f["C"], mu=f["Mue"], var=f["U"], cut=-0.1 if f.get("density") == "1" else None, **shared)
        out += [m] * int(f.get("multip", 1))
    return out


def text_of_model(m: Model) -> str:
    """Text that parse_models reads."""
    grid = lambda x: "{\n" + "\n".join("\t" + ", ".join(repr(float(v)) for v in row) + ";" for row in np.atleast_2d(x)) + "\n\t}"
    kind = "HMM" if m.b is not None else "SHMM"
    lines = [f"M = {m.symbols if m.b is not None else m.c.shape[1]};", f"N = {m.n};", f"prior = {m.prior};", f"Pi = vector {grid(m.pi)};"]
    lines += [f"cos = {len(m.a)};", "density = 0;"] if m.b is None else []
    lines += [f"Ak_{k} = matrix {grid(x)};" for k, x in enumerate(m.a)] if len(m.a) > 1 else [f"A = matrix {grid(m.a[0])};"]
    lines += [f"B = matrix {grid(m.b)};"] if m.b is not None else [f"{k} = matrix {grid(x)};" for k, x in (("C", m.c), ("Mue", m.mu), ("U", m.var))]
    lines += [f"fix_state = vector {grid(np.array(m.fixed, float))};"] if m.fixed else []
    return f"{kind} = {{\n\t" + "\n\t".join(lines) + "\n};\n"


def grid_lines(x, tab: str = "", separator: str = ",", ending: str = ";", pattern: str = "%.2f", transposed: bool = False) -> list[str]:
    """A line for each row of a matrix (for each column if transposed); a vector is one row. Serves A, B, Pi, C, Mue, U, fixed states and labels."""
    x = np.atleast_2d(np.asarray(x))
    return [tab + f"{separator} ".join(pattern % v for v in row) + ending for row in (x.T if transposed else x)]


def state_lines(m: Model) -> list[str]:
    """Of a model of symbols, for each state: its start, its emissions, and the edges out of it and into it."""
    edges = lambda p: "".join(f"({j}, {p[j]:.3f}) \t" for j in np.flatnonzero(p))
    a, out = m.a[0], [f"Modelparameters: \n M = {m.symbols} \t N = {m.n}"]
    for i in range(m.n):
        out += ["", f"State {i} ", f" PI = {m.pi[i]:.3f} ", f" out_states = {np.count_nonzero(a[i])} ", f" in_states = {np.count_nonzero(a[:, i])} "]
        out += [" Output probability:\t" + "".join(f"{p:.3f} \t" for p in m.b[i]), " Transition probability "]
        out += ["  Out states (Id, a):\t" + edges(a[i]), "  In states (Id, a):\t" + edges(a[:, i])]
    return out


QUALIFIERS = ("gene", "note", "product", "codon_start", "translation")


def read_genbank(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """contig (contig_id, seq) and feature (contig_id, feature_id, type, idx1, idx2, parts, and the qualifiers) of GenBank flat files.

    Complements have idx1 > idx2. parts: the pieces (lo, hi) of a joined place, in the order of the file; idx1 and idx2 span them.
    Qualifiers that a feature lacks are null; lines of one are joined by a space, those of a translation by nothing.
    A feature without a range of places (a single base, or a place in another record) is left out.
    """
    records = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.replace("value", F.lit("\r"), F.lit("")), r"\n//")).alias("r")).where(F.col("r").rlike("(?m)^LOCUS"))
    records = records.withColumn("contig_id", F.regexp_extract("r", r"(?m)^ACCESSION\s+(\S+)", 1))
    contigs = records.select("contig_id", F.regexp_replace(F.regexp_extract("r", r"(?s)\nORIGIN[^\n]*\n(.*)$", 1), r"[\s\d]+", "").alias("seq"))
    # A feature: a key at column 6 and the lines after it that begin further right.
    block = r"(?m)^ {5}\S[^\n]*(?:\n {6,}[^\n]*)*+"
    hits = records.select("contig_id", F.posexplode(F.regexp_extract_all("r", F.lit(block), F.lit(0))).alias("feature_id", "x"))
    hits = hits.withColumn("place", F.regexp_replace(F.regexp_extract("x", r"^ {5}\S+([^/]*)", 1), r"\s+", ""))
    pieces = F.regexp_extract_all("place", F.lit(r"(?<![\w.:])<?\d+\.\.>?\d+"), F.lit(0))
    end = lambda p, i: F.regexp_replace(F.split(p, r"\.\.")[i], "[<>]", "").cast("long")
    hits = hits.withColumn("parts", F.transform(pieces, lambda p: F.struct(end(p, 0).alias("lo"), end(p, 1).alias("hi")))).where(F.size("parts") > 0)
    lo, hi, back = F.array_min(F.col("parts.lo")), F.array_max(F.col("parts.hi")), F.col("place").contains("complement(")

    def qualifier(name):
        text = F.regexp_extract("x", rf'(?s)\n {{6,}}/{name}="((?:[^"]|"")*+)"', 1)
        bare = F.regexp_extract("x", rf"\n {{6,}}/{name}=([^\"\s]+)", 1)
        return F.nullif(F.replace(F.regexp_replace(F.concat(text, bare), r"\s*\n\s*", "" if name == "translation" else " "), F.lit('""'), F.lit('"')), F.lit("")).alias(name)

    kind = F.regexp_extract("x", r"(\S+)", 1).alias("type")
    return contigs, hits.select("contig_id", F.col("feature_id").cast("long"), kind, F.when(back, hi).otherwise(lo).alias("idx1"), F.when(back, lo).otherwise(hi).alias("idx2"), "parts", *map(qualifier, QUALIFIERS))
