"""Secret scans with multipart credential linking.

Base detectors find assignments, access identifiers and hexadecimal runs.  Weak parts (bare identifiers of a
part kind: short access ids, secret-looking blobs, endpoints) are not secrets alone; inside a scope they are
interval-joined, and a part is reported only when a complementary part overlaps its reach.

Defined results: a null text is empty and has no spans; nulls in other columns and repeated rows change
nothing; an empty table gives an empty result; extra columns are ignored (``doc_id`` and ``text`` are read).
"""

from __future__ import annotations

import re
from heapq import heappop, heappush

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, map_texts, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
HEX_MAP = bytes(49 if chr(c) in "0123456789abcdef" else 48 for c in range(256))
HEX_RUN = b"1" * 24
BLOB_MAP = bytes(49 if chr(c).isascii() and (chr(c).isalnum() or chr(c) in "+/_-") else 48 for c in range(256))
BLOB_RUN = b"1" * 30
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE_KINDS = ("assign", "access", "hex")
# parts: candidates too weak to report alone
PART_ID = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AIDA)[A-Z0-9]{8,}(?![A-Za-z0-9])")
PART_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{30,}+)={0,2}+(?![A-Za-z0-9+/_=-])")  # of any length
SECRET_NEEDS = tuple(re.compile(c) for c in ("[0-9]", "[A-Z]", "[a-z]"))
PART_ENDPOINT = re.compile(r"(?:https?|postgres|mysql|mongodb|redis|amqp)://[^\s\"'<>]{4,}")
SCOPE_END = re.compile(r"\n[ \t]*\n")
REACH = 200
KIND_ORDER = ("assign", "access", "hex", "linked_id", "linked_secret", "linked_endpoint")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base detectors, in code points."""
    out = []
    flat = text.encode("latin-1", "replace")  # one byte a code point: cheap tests of whether a detector can match at all
    low = flat.lower()
    if any(w in low for w in HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in flat:  # a run that starts with AKIA has the longest match at its first one, so {16,} keeps what 20 characters keep
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    if HEX_RUN in flat.translate(HEX_MAP):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def parts(text: str) -> list[tuple[int, int, str]]:
    out = []
    if "://" in text:
        out += [(m.start(), m.end(), "endpoint") for m in PART_ENDPOINT.finditer(text)]
    if "AKIA" in text or "ASIA" in text or "AIDA" in text:
        out += [(m.start(), m.end(), "id") for m in PART_ID.finditer(text)]
    if BLOB_RUN in text.encode("latin-1", "replace").translate(BLOB_MAP):
        out += [(m.start(), m.end(), "secret") for m in PART_SECRET.finditer(text) if all(c.search(m[1]) for c in SECRET_NEEDS)]
    return out


def link_parts(found: list[tuple[int, int, str]], breaks: list[int], reach: int = REACH) -> set[tuple[int, int, str]]:
    """Spans with a part of another kind in the same scope whose interval, widened by ``reach``, meets theirs.

    An identifier or an endpoint needs a secret; a secret needs an identifier or an endpoint.  One sweep by
    start: open intervals are kept in a heap for each kind by end, and for every kind only whether one is open
    matters, so the work is n log n whatever the number of overlaps.
    """
    scope, at, linked = 0, 0, set()
    need = {"id": ("secret",), "endpoint": ("secret",), "secret": ("id", "endpoint")}
    waiting: dict[str, list] = {k: [] for k in need}  # not yet linked, by end
    last_end = dict.fromkeys(need, -1)
    for start, end, kind in sorted(found):
        while at < len(breaks) and breaks[at] <= start:
            at += 1
        if at != scope:
            scope, last_end = at, dict.fromkeys(need, -1)
            waiting = {k: [] for k in need}
        hit = False
        for other in need[kind]:
            hit |= last_end[other] >= start
            queue = waiting[other]
            while queue:
                e, s, e0 = heappop(queue)
                if e >= start:
                    linked.add((s, e0, other))
        if hit:
            linked.add((start, end, kind))
        else:
            heappush(waiting[kind], (end + reach, start, end))
        last_end[kind] = max(last_end[kind], end + reach)
    return linked


def scan(text: str | None) -> dict:
    """Base spans, linked spans and their joined forms for one whole text."""
    text = text or ""
    base = sorted(base_spans(text), key=lambda x: (x[0], KIND_ORDER.index(x[2])))
    weak = parts(text)
    linkable = weak + [(s, e, "id") for s, e, k in base if k == "access"] + [(s, e, "secret") for s, e, k in base if k in ("assign", "hex")]
    extra: set[tuple[int, int, str]] = set()
    if weak and len({k for *_, k in linkable}) > 1:
        taken = {(s, e) for s, e, _ in base}
        extra = {(s, e, f"linked_{k}") for s, e, k in link_parts(list(set(linkable)), [m.start() for m in SCOPE_END.finditer(text)]) if (s, e) not in taken}
    join = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
    return {
        "n_assign": sum(k == "assign" for *_, k in base), "n_access": sum(k == "access" for *_, k in base), "n_hex": sum(k == "hex" for *_, k in base),
        "base": join(base), "spans": join(sorted([*base, *extra], key=lambda x: (x[0], KIND_ORDER.index(x[2]), x[1]))), "n_linked": len(extra),
    }


FIELDS = [("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("n_linked", "long"), ("base", "string"), ("spans", "string")]


def _scanner():
    def run(texts):
        found = [scan(t) for t in texts]
        return [[f[name] for f in found] for name, _ in FIELDS]

    return run


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per document: counts, base spans and all spans as ``kind:start:end`` lists.  No shuffle."""
    return map_texts(docs.select("doc_id", "text"), _scanner, FIELDS)


def redact(text: str | None, mask: str = "[SECRET]") -> str | None:
    """``text`` with every reported span replaced; overlapping spans become one mask."""
    if not text or not (spans := scan(text)["spans"]):
        return text
    out, at = [], 0
    for s, e in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in spans.split(",")):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _redactor():
    return lambda texts: [[redact(t) for t in texts]]


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets masked in ``text`` (n_chars follows where it exists); all rows and columns stay."""
    masked, = fresh(docs, "_masked")
    out = map_texts(docs, _redactor, [(masked, "string")]).withColumnRenamed(masked, "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all documents, whole texts; base_sha256 digests the base spans."""
    found = secret_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans", "n_linked")
