"""Terms of texts and bounded parts of an item table, for search and decontamination.

A term is a run of ASCII letters and digits and of characters beyond ASCII, with only A-Z lower-cased.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .units import Words

#: The same pattern for a text whose A-Z are lower-cased already.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What each byte becomes: itself in a term, a small letter for a capital, a space between terms.
TABLE = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Bytes of item texts that are broadcast at once.
PART_BYTES = 32 << 20
PIECE = 1 << 22


def folded(text: str | None) -> bytes:
    """The text's bytes, as many as before, with spaces for all that stands between terms."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE)


def pieces(data: bytes, size: int = PIECE):
    """(begin, end) of parts of about `size` bytes, cut at spaces."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        yield at, end
        at = end


class Tokens:
    """Hash, first and end byte of the terms of folded texts in `data`; terms first[i]:first[i+1] are text i's. Long texts go through in pieces."""

    def __init__(self, texts: list[bytes], size: int = PIECE):
        self.data = b" ".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        base = np.concatenate([[0], np.cumsum(lengths)])
        parts = [(at, Words([self.data[at:end]])) for at, end in pieces(self.data, size)]
        whole = lambda name, add: np.concatenate([getattr(w, name) + (at if add else np.uint64(0)) for at, w in parts]) if parts else np.empty(0, np.int64 if add else np.uint64)
        self.hash, self.start, self.end = whole("hash", False), whole("start", True), whole("end", True)
        self.first = np.searchsorted(self.start, base)

    def words(self, lo: int, hi: int) -> bytes:
        return b" ".join(self.data[a:b] for a, b in zip(self.start[lo:hi].tolist(), self.end[lo:hi].tolist()))


def item_parts(items: DataFrame, most: int = PART_BYTES):
    """Lists of (item_id, folded text) of the different items that have a text. All at once where their texts, which are summed first, have `most` bytes
    together; else dealt by hash into parts of about half that."""
    items = items.select("item_id", "text").where("octet_length(text) > 0").distinct()
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = 1 if total <= most else -(-2 * total // most)
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield [(r["item_id"], folded(r["text"])) for r in part.collect()]
