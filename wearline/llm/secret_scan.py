"""Secret scan with corpus-wide ownership: copied examples and live-looking credentials are told apart by who has them.

1. Every whole text is scanned for the base kinds and for further kinds that only count if they look live. Candidates
   (kind, place, hash of the secret value) are written to the shared folder; texts are not shuffled.
2. Candidate hashes are aggregated over the corpus: in how many repositories and by how many owners does each one occur? Counting goes
   over (hash, owner, repository), then (hash, owner), then hash, so a value that a third of all rows repeat is combined early.
3. A value that `EXAMPLE_OWNERS` or more owners or `EXAMPLE_REPOSITORIES` or more repositories share is an example, whoever owns
   those; all others belong to someone. Base spans always stay and carry
   the verdict; spans of further kinds are added where the value is owner-specific and not a placeholder.

Kinds are listed in `KINDS`. Places are code points, end exclusive, over the whole match.

Defined results: NULL text counts as empty and has no spans ('' joined); NULL owners count together as one owner, NULL repositories as one
repository; repeated rows are scanned and answered one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import arrow_map, cut, whole_text

#: Base kinds first, in the order that ties follow.
KINDS = ("assign", "access", "hex", "pem", "jwt", "bearer", "url")
BASE = 3
#: A value with this many owners is a copied example.
EXAMPLE_OWNERS = 10
#: So is one that stands in this many repositories, whatever the owners.
EXAMPLE_REPOSITORIES = 100

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is found as a run of any length would be
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_BEARER = re.compile(r"\b[Bb]earer\x20+([A-Za-z0-9+/_.=-]{16,})")
_URL = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s/:@]*:([^\s/:@]{6,})@")
#: What stands in place of a secret.
_PLACEHOLDER = re.compile(r"(?i)x{6,}|\*{4,}|example|changeme|your[_-]|placeholder|<|\$\{|0{12,}|123456")


def spans(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, hash of the value) of every candidate, by start, then kind."""
    found: list[tuple[int, int, int, str]] = []
    small = text.lower()
    if "pass" in small or "secret" in small or "token" in small or "api" in small:
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            stop = text.find("-----END ", m.end())
            close = text.find("-----", stop + 9) if stop >= 0 else -1
            if close >= 0:
                found.append((m.start(), 3, close + 5, text[m.end() : stop]))
    if "eyJ" in text:
        found += [(m.start(), 4, m.end(), m[0]) for m in _JWT.finditer(text)]
    if "earer " in text:
        found += [(m.start(), 5, m.end(), m[1]) for m in _BEARER.finditer(text)]
    if "://" in text:
        found += [(m.start(), 6, m.end(), m[1]) for m in _URL.finditer(text)]
    kept = [f for f in found if f[1] < BASE or not _PLACEHOLDER.search(f[3])]
    return [(kind, start, end, xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass")) - (1 << 63)) for start, kind, end, value in sorted(kept)]


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64())])


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """The written table (row, doc_id, repository, owner, found) of all rows, those without candidates included."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "value"), s)) for s in spans(t)] for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(_SPAN))], names=["doc_id", "repository", "owner", "found"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(repository_col).cast("string").alias("repository"), F.col(owner_col).cast("string").alias("owner"), whole_text(text_col).alias("text"))
    found = arrow_map(rows, scanned, "doc_id long, repository string, owner string, found array<struct<kind:int,start:int,end:int,value:bigint>>")
    return cut(found.withColumn("row", F.monotonically_increasing_id()))


def ownership(found: DataFrame) -> DataFrame:
    """value, repositories and owners of every candidate hash."""
    seen = found.select(F.explode(F.array_distinct(F.transform("found", lambda s: s["value"]))).alias("value"), "repository", "owner")
    pairs = seen.distinct()
    owners = pairs.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return owners.groupBy("value").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """row, doc_id and spans (kind, start, end, owners, repositories, live) of every row, by start, then kind."""
    found = candidates(docs, id_col, text_col, repository_col, owner_col)
    counts = ownership(found)
    each = found.select("row", F.explode("found").alias("s")).select("row", "s.*")
    live = (F.col("owners") < example_owners) & (F.col("repositories") < example_repositories)
    judged = (
        each.join(counts, "value")
        .where((F.col("kind") < BASE) | live)
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "owners", "repositories", live.alias("live")))).alias("spans"))
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int,owners:bigint,repositories:bigint,live:boolean>>")
    return found.select("row", "doc_id").join(judged, "row", "left").select("row", "doc_id", F.coalesce("spans", none).alias("spans"))


def summary(scanned: DataFrame) -> DataFrame:
    """The digest of `scan`: one row per document."""
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    return scanned.select(
        "doc_id", *[count(k) for k in range(BASE)],
        F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", shown), ",").alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """`docs` with every live span overwritten by as many asterisks; examples and all other columns stay.

    Rows are written once with a number by which spans travel to their text; only rows with live spans change.
    """
    rows = cut(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.monotonically_increasing_id().alias("row")))
    plain = rows.select("row", F.col(f"d.`{text_col}`").alias("text"), F.col(f"d.`{repository_col}`").alias("repository"), F.col(f"d.`{owner_col}`").alias("owner"))
    live = F.filter("spans", lambda s: s["live"])
    scanned = scan(plain, "row", "text", "repository", "owner").select(F.col("doc_id").alias("row"), F.transform(live, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("hits"))
    joined = rows.join(scanned.where(F.size("hits") > 0), "row", "left").select("d", "hits")
    at = docs.columns.index(text_col)

    def overwrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, hits = batch.column(0).flatten(), batch.column(1).to_pylist()
            if any(hits):
                texts = columns[at].to_pylist()
                for i, places in enumerate(hits):
                    for place in places or ():
                        texts[i] = texts[i][: place["start"]] + "*" * (place["end"] - place["start"]) + texts[i][place["end"] :]
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return arrow_map(joined, overwrite, fields).toDF(*docs.columns)
