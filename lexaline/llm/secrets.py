"""Secret scans with corpus-wide ownership frequency.

Each text is scanned for candidates: the base kinds assign, access and hex, and the added kinds below,
whose shapes are those of real issuers' credentials.  Candidates are hashed and counted over the corpus:
distinct repositories and distinct owners that hold each value.  A value that COPIED or more owners hold, or SPREAD or
more repositories whoever owns them, is a widely copied example; any other is live-looking if it is random enough,
else weak.  A credential that an owner reuses stands in some repositories, a pasted example in very many.
Base spans always stay; spans of added kinds stay if they are live-looking.

Only (value hash, repository, owner) goes through the shuffle, each once per task; a value that stands in
a third of all documents is counted by repository and owner first.  The verdicts go back to documents by an
equi-join on the hash, whose hot keys adaptive execution splits.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, texts_of

BASE = ("assign", "access", "hex")
#: The base patterns, and public shapes of tokens.
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ADDED = {
    "private": re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[\s\\rn]{1,8}([A-Za-z0-9+/=]{16,})"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "github": re.compile(r"gh[opsu]_[A-Za-z0-9]{36,}"),
    "slack": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "stripe": re.compile(r"[rs]k_live_[A-Za-z0-9]{16,}"),
    "google": re.compile(r"AIza[A-Za-z0-9_-]{35}"),
    "url": re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:([^\s:/@]{6,64})@"),
}
#: A text without these, in lower case, has no match of the kind.
HINTS = {"private": (b"private key-----",), "jwt": (b"eyj",), "github": (b"gho_", b"ghp_", b"ghs_", b"ghu_"), "slack": (b"xox",), "stripe": (b"k_live_",), "google": (b"aiza",), "url": (b"://",)}
WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
COPIED, SPREAD, RANDOM = 3, 50, 3.0
KINDS = (*BASE, *ADDED)
HEX = np.zeros(256, bool)
HEX[[*range(48, 58), *range(97, 103)]] = True


def hex_runs(raw: bytes) -> list[tuple[int, int]]:
    """Byte spans of the longest runs of [0-9a-f] that have 24 or more."""
    if len(raw) < 24:
        return []
    is_hex = HEX[np.frombuffer(raw, np.uint8)]
    # such a run covers a multiple of 24 and its neighbours: look closer only where a sampled byte is one
    if not is_hex[23::24].any():
        return []
    edge = np.flatnonzero(np.diff(is_hex.view(np.int8), prepend=0, append=0))
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= 24
    return list(zip(begin[long].tolist(), end[long].tolist(), strict=True))


def scan(raw: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of all candidates in code points, in order of start and kind."""
    low, found = raw.lower(), []
    text = None
    if any(w in low for w in WORDS):
        text = raw.decode("utf-8", "replace")
        found += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        text = text or raw.decode("utf-8", "replace")
        found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    done = chars = 0
    for a, b in hex_runs(raw):
        chars += len(raw[done:a].decode("utf-8", "replace"))
        found.append((chars, chars + b - a, "hex", raw[a:b].decode()))
        chars, done = chars + b - a, b
    for kind, hints in HINTS.items():
        if any(h in low for h in hints):
            text = text or raw.decode("utf-8", "replace")
            found += [(m.start(), m.end(), kind, m[1] if m.lastindex else m[0]) for m in ADDED[kind].finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def entropy(value: str) -> float:
    """Bits per character, by the value's own characters."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.int64()), ("random", pa.bool_())]))


def candidates(batches):
    for x in batches:
        found = [[{"start": a, "end": b, "kind": kind, "value": xxhash.xxh3_64_intdigest(value) - (1 << 63), "random": entropy(value) >= RANDOM} for a, b, kind, value in scan(text)] for text in texts_of(x.column(4))]
        yield pa.RecordBatch.from_arrays([*(x.column(i) for i in range(4)), pa.array(found, SPAN)], ["row", "doc_id", "repo", "owner", "found"])


def joined(spans: list[dict]) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def report(batches):
    for x in batches:
        out = []
        for found in x.column(1).to_pylist():
            spans = sorted(found or [], key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))
            base = [s for s in spans if s["kind"] in BASE]
            n = Counter(s["kind"] for s in base)
            every = [s for s in spans if s["kind"] in BASE or s["verdict"] == "live"]
            verdicts = Counter(s["verdict"] for s in every)
            most = [max((s[c] for s in spans), default=0) for c in ("repos", "owners")]
            out.append((n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), verdicts["live"], verdicts["copied"], verdicts["weak"], *most))
        kinds = (*[pa.int64()] * 3, pa.string(), pa.string(), *[pa.int64()] * 5)
        yield pa.RecordBatch.from_arrays([x.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 10, kinds, strict=True))], ["doc_id", *COLUMNS])


COLUMNS = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_copied", "n_weak", "most_repos", "most_owners"]


def ownership(found: DataFrame) -> DataFrame:
    """value, repos, owners: by how many distinct repositories and owners each candidate value is held."""
    each = found.groupBy("value", "repo", "owner").agg(F.lit(1).alias("one"))
    return each.groupBy("value").agg(F.countDistinct("repo").alias("repos"), F.countDistinct("owner").alias("owners"))


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: str = "doc_id", owner: str = "source", copied: int = COPIED, spread: int = SPREAD) -> DataFrame:
    """Candidates of every document, told apart by who else holds them.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, n_weak, and most_repos and
    most_owners, by how many repositories and owners the document's most widely held value is held.  Offsets are code
    points, ends exclusive.  A null or empty text has none: zero counts, no spans, the hash of an empty
    string.  A null repository or owner is nobody: it isn't counted, so a value held only by such has no
    owners and is no copy.  Rows that share a doc_id each have their own report.  Other columns are ignored.
    An empty table gives no rows.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"), F.col(text).alias("text"))
    scanned = keep(own.mapInArrow(candidates, f"row long, doc_id {id_type}, repo string, owner string, found array<struct<start:long,end:long,kind:string,value:long,random:boolean>>"))
    found = scanned.select("row", "repo", "owner", F.explode("found").alias("span")).select("*", F.col("span.value").alias("value"))
    verdict = F.when((F.col("owners") >= copied) | (F.col("repos") >= spread), "copied").when(F.col("span.random"), "live").otherwise("weak")
    told = found.join(ownership(found), "value").select("row", F.struct("span.start", "span.end", "span.kind", verdict.alias("verdict"), "repos", "owners").alias("span"))
    spans = told.groupBy("row").agg(F.collect_list("span").alias("found"))
    return scanned.select("row", "doc_id").join(spans, "row", "left").select("doc_id", "found").mapInArrow(report, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_live long, n_copied long, n_weak long, most_repos long, most_owners long")
