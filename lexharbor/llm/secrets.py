"""Operator 1: secret scans by dictionary-primed zstandard novelty.

Three fixed patterns give the base spans.  The method adds spans: a candidate is a run of 16 or more key characters
with letters and digits that starts within REACH characters after a sensitive word.  Its marginal size is what it adds
to the zstandard frame of the surrounding text, compressed with a raw-content dictionary of identifiers: a fixed list of
common ones and the LEARNED most frequent ones that stand near sensitive words in the table itself, counted by documents.
Only whole runs without digits are learned, so no part of a key is, however many copies it has.  Text that is built from
known identifiers or repeats its surroundings adds little; a random key adds nearly all its bits.

Defined cases.  Null text: empty, no spans, the digest of the empty string.  Empty table: no rows.  Repeated rows give
repeated results.  Texts are scanned whole, in time linear in their length however many sensitive words or spans they
hold.  Only the key and text columns are read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, read_texts, released, schema, small_batches, table, texts

#: Least marginal bytes per character, and characters of context before, after and between word and candidate.
NOVELTY, BEFORE, AFTER, REACH = 0.55, 512, 128, 48
#: Least characters of a run; a run up to SHORT is measured from each sensitive word in it.
LEAST, SHORT = 16, 256
#: Identifiers learned from the table.
LEARNED = 2048
KINDS = ("assign", "access", "hex", "novel")
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
SENSITIVE = ("password", "passwd", "passphrase", "secret", "token", "api_key", "apikey", "api key", "access key", "private key", "credential", "bearer", "authorization", "client_id", "signature")
IDENTIFIERS = (
    "access_key accessKey account address algorithm api_key apikey application args array assert async authorization await base64 bearer boolean "
    "bucket buffer callback certificate class client_id client_secret config configuration connection const content context cookie credential "
    "database debug default description development document domain element encode endpoint environment error example export false filename "
    "format function generate github handler header host http https identifier import index instance integer interface json key label length "
    "library license localhost logger message method module name namespace null object option output package parameter parse password path port "
    "prefix private process production protocol public query random readonly region registry release request response result return schema secret "
    "server service session sha256 signature source staging static status string struct system table template test token true type undefined "
    "update upload user username uuid value variable version window"
)
_ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{16,}")
_WORD = re.compile("|".join(sorted(map(re.escape, SENSITIVE), key=len, reverse=True)))
_RUN, _KEY = re.compile(rf"[A-Za-z0-9+/_=.\-]{{{LEAST}}}"), re.compile(r"[A-Za-z0-9+/_=.\-]*")
_NAME = re.compile(r"(?<![A-Za-z0-9+/=_.\-])[A-Za-z_]{4,40}(?![A-Za-z0-9+/=_.\-])")
_DIGIT, _ALPHA = re.compile(r"[0-9][^0-9]*[0-9]"), re.compile(r"[A-Za-z]")


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns; low is the text with letters lowered, used only to skip patterns."""
    out = []
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]  # a run under 16 has no longer run inside
    return sorted(out)


def _near(text: str, low: str) -> set[str]:
    """Whole identifiers without digits within BEFORE characters before a sensitive word and AFTER behind it."""
    found, done = set(), 0
    for w in _WORD.finditer(low):
        lo, hi = max(done, w.start() - BEFORE), min(len(text), w.end() + AFTER)
        if hi > lo:
            found.update(m[0] for m in _NAME.finditer(text, lo, hi))
        done = max(done, hi)
    return found


def learn_identifiers(docs: DataFrame, most: int = LEARNED) -> str:
    """The fixed identifiers after the most frequent ones near sensitive words, rare ones first (the end of a dictionary
    is the nearest).  Counts cover all documents; `most` words come to the driver."""
    out = schema("word:string,n:long")

    def run(batches):
        for b in batches:
            n: Counter[str] = Counter()
            for t in b.column(1).to_pylist():
                low = (t or "").lower()
                if len(low) == len(t or "") and any(w in low for w in SENSITIVE):
                    n.update(_near(t, low))
            if n:
                yield table(out, word=list(n), n=list(n.values()))

    found = texts(docs.select(F.lit(None).cast("long").alias("doc_id"), "text")).mapInArrow(released(run), out).groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    words = [r.word for r in found.orderBy(F.desc("n"), "word").limit(most).collect()]
    return " ".join([*reversed(words), IDENTIFIERS])


class Novelty:
    """Marginal compressed sizes against the identifiers and the surrounding text."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 6):
        known = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=level)
        self.frame = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=False, write_content_size=False)

    def size(self, data: bytes) -> int:
        return len(self.frame.compress(data))

    def of(self, text: str, start: int, end: int) -> float:
        """Bytes per character that text[start:end] adds to its surroundings."""
        around = (text[end : end + AFTER] + "\n" + text[max(0, start - BEFORE) : start]).encode()
        return (self.size(around + text[start:end].encode()) - self.size(around)) / max(1, end - start)


def _covered(base: list[tuple[int, int, int]]):
    """A test whether [s, e) meets one of the sorted spans, by binary search."""
    starts, furthest = [x[0] for x in base], [0, *accumulate((x[2] for x in base), max)]
    return lambda s, e: furthest[bisect_left(starts, e)] > s


def novel_spans(text: str, low: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Incompressible runs that start within REACH after a sensitive word, outside the base spans.  Every run is tested
    that starts there; a run that begins before the word's end is taken from there on.  The work is linear: the end of a
    long run is looked up once, and a second start in a run already measured is measured only if what is left of it is
    at most half as long, or at most SHORT."""
    if not any(w in low for w in SENSITIVE) and len(low) == len(text):
        return []
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)  # keeps offsets
    out, seen, covered = [], set(), _covered(base)
    stops, trims, last = [], [], []  # the runs met so far, in order: end, end without points, length last measured
    for w in _WORD.finditer(low):
        at, most = w.end(), w.end() + REACH
        while at <= most:
            m = _RUN.search(text, at, most + LEAST)  # a run's first LEAST characters, within reach
            if not m:
                break
            s = m.start()
            run = bisect_right(stops, s)
            if run == len(stops):
                stops.append(_KEY.match(text, s).end())
                trims.append(s + len(text[s : stops[-1]].rstrip(".-")))
                last.append(1 << 62)
            at, e = stops[run], trims[run]
            if s in seen:
                continue
            seen.add(s)
            if e - s < LEAST or e - s > SHORT and 2 * (e - s) > last[run] or covered(s, e):
                continue
            last[run] = e - s
            if _DIGIT.search(text, s, e) and _ALPHA.search(text, s, e) and novelty.of(text, s, e) >= NOVELTY:
                out.append((s, 3, e))
    return sorted(out)


def scan(text: str, novelty: Novelty) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    low = text.lower()
    base = base_spans(text, low)
    return base, novel_spans(text, low, base, novelty)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


SPANS = schema("doc_id:long,n_assign:long,n_access:long,n_hex:long,n_novel:long,base_sha256:string,spans:string")


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, the digest of the base spans and all spans, in code points."""
    identifiers = learn_identifiers(docs)

    def run(batches):
        novelty = Novelty(identifiers)
        for b in batches:
            ids = b.column(0)
            for c in chunks(b.column(1)):
                n, sha, said = ([], [], [], []), [], []
                for i in range(len(c)):
                    base, new = scan(c.bytes_of(i).decode("utf-8", "replace"), novelty)
                    for k in range(4):
                        n[k].append(sum(x[1] == k for x in base) if k < 3 else len(new))
                    sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    said.append(joined(base + new))
                yield table(SPANS, doc_id=ids.slice(c.lo, len(c)), n_assign=n[0], n_access=n[1], n_hex=n[2], n_novel=n[3], base_sha256=sha, spans=said)

    return texts(docs).mapInArrow(released(run), SPANS)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with every span in the text replaced by the mark; n_chars, where there, follows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = docs.schema
    at, kinds = [f.name for f in out].index("text"), to_arrow_schema(out)
    identifiers = learn_identifiers(docs)

    def run(batches):
        import pyarrow as pa

        novelty = Novelty(identifiers)
        for b in batches:
            new = []
            for t in b.column(at).to_pylist():
                if t:
                    end, parts = 0, []
                    for s, _, e in sorted(sum(scan(t, novelty), [])):
                        if s >= end:
                            parts += [t[end:s], mark]
                        end = max(end, e)
                    t = "".join(parts) + t[end:] if parts else t
                new.append(t)
            cols = list(b.columns)
            cols[at] = pa.array(new, kinds.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=kinds)

    small_batches(docs.sparkSession)
    done = docs.mapInArrow(released(run), out)
    return done.withColumn("n_chars", F.length("text").cast(out["n_chars"].dataType)) if "n_chars" in docs.columns else done


def op1_secret_scans(spark, sf_dir: str) -> DataFrame:
    return find_secrets(read_texts(spark, sf_dir))
