"""Secret scanning with corpus-wide ownership: values seen under one owner are live-looking, widely copied ones are examples."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from barlab.llm.common import slices, store

#: The kinds in their listed order.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A bare run that may be a credential: letters and digits mixed, 20 characters or more.
BARE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}")
#: What a text must hold for any of the patterns to match; a cheap test that runs outside Python.
MAYBE = r"(?i:passw(or)?d|secret|token|api_?key)|AKIA[A-Z0-9]{12}|[0-9a-f]{32}|[A-Za-z0-9+/_-]{20}"


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the fixed patterns, in code points, end exclusive."""
    found = [("assign", m.start(), m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    found += [("access", m.start(), m.end(), m.group()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m.group()) for m in HEX.finditer(text)]
    return found


def digest(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()


def candidates(docs: DataFrame, min_bits: float) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, repository, owner) with its candidate spans and the sha256 of their values."""

    def scan(batches):
        for batch in slices(batches):
            maybe = pc.fill_null(pc.match_substring_regex(batch.column("text"), MAYBE), False).to_pylist()
            texts, rows = batch.column("text"), []
            for i, flag in enumerate(maybe):
                found = []
                if flag:
                    text = texts[i].as_py()
                    found = base_spans(text)
                    taken = [(s, e) for _, s, e, _ in found]
                    for m in BARE.finditer(text):
                        if entropy(m.group()) >= min_bits and not any(s < m.end() and m.start() < e for s, e in taken):
                            found.append(("owned", m.start(), m.end(), m.group()))
                    found.sort(key=lambda f: (f[1], KINDS.index(f[0])))
                rows.append([{"kind": k, "begin": s, "stop": e, "value_sha256": digest(v)} for k, s, e, v in found])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "repository", "owner")), pa.array(rows, pa.list_(SPAN))],
                names=["doc_id", "repository", "owner", "found"])

    return docs.mapInArrow(
        scan, "doc_id long, repository string, owner string, found array<struct<kind:string,begin:long,stop:long,value_sha256:string>>")


SPAN = pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("stop", pa.int64()), ("value_sha256", pa.string())])


def ownership(found: DataFrame) -> DataFrame:
    """(value_sha256, n_places, n_repositories, n_owners) over the whole corpus; a hot value shrinks before each shuffle."""
    flat = found.select("repository", "owner", F.explode(F.array_distinct(F.transform("found", lambda f: f.value_sha256))).alias("value_sha256"))
    by_repo = flat.groupBy("value_sha256", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("value_sha256", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("value_sha256").agg(
        F.sum("n").alias("n_places"), F.sum("repos").alias("n_repositories"), F.count("*").alias("n_owners"))


def scan_secrets(docs: DataFrame, repository: str = "source", owner: str = "source", widely_owners: int = 2,
                 min_bits: float = 3.0) -> DataFrame:
    """Per row of ``docs``: base counts and spans, and the method's own: bare values under fewer than ``widely_owners`` owners.

    ``repository`` and ``owner`` name columns of ``docs``; nulls form one owner. A null text is empty; rows with
    no candidate have zero counts, the sha256 of the empty text and an empty ``spans``. Rows are judged
    one by one, so a null or repeated doc_id is kept. ``n_live`` counts spans whose value stays with fewer than
    ``widely_owners`` owners, ``n_copied`` those copied more widely.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
                         F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"))
    rows = store(candidates(narrow, min_bits).withColumn("row", F.monotonically_increasing_id()), "secrets")
    spans = rows.select("row", F.explode("found").alias("f")).select("row", "f.*")
    judged = spans.join(ownership(rows), "value_sha256").withColumn("live", F.col("n_owners") < widely_owners)
    per_row = judged.groupBy("row").agg(
        F.sum(F.col("live").cast("long")).alias("n_live"), F.sum((~F.col("live")).cast("long")).alias("n_copied"),
        F.collect_list(F.when((F.col("kind") == "owned") & F.col("live"), F.struct("begin", "stop"))).alias("added"))
    joined = rows.join(per_row, "row", "left")
    label = lambda f: F.concat_ws(":", f.kind, f.begin.cast("string"), f.stop.cast("string"))
    base = F.filter("found", lambda f: f.kind != "owned")
    stays = F.filter("found", lambda f: (f.kind != "owned") | F.exists(F.coalesce("added", F.array()), lambda a: a.begin == f.begin))
    count = lambda k: F.size(F.filter("found", lambda f: f.kind == k)).cast("long").alias(f"n_{k}")
    return joined.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(F.concat_ws(",", F.transform(base, label)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform(stays, label)).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))
