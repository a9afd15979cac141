"""Secret scans over a blob ledger.

Every historical version of a path is content-addressed by the SHA-256 of its text. Only (blob, rule, rule version)
triples that the ledger lacks are scanned, one representative row per blob, and the findings of the rules' current
versions are joined back to all paths that hold the blob. Hashes travel, not texts: a text is shuffled only to meet the
list of unseen blobs, and not at all when that list has no more than FEW_BLOBS rows, as it is broadcast then.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import _hadoop, discard, map_rows, packed, tables_dir


class Rule(NamedTuple):
    """A match of `pattern` is a finding if its `group` has `least` characters or more."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


#: The base rules, in the order in which spans of equal start are listed.
RULES = (
    Rule("assign", 1, r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, r"[0-9a-f]+", 0, 32),
)

#: For rules whose matches all have a cheap mark: texts without it are not searched.
MARKS = {"assign": re.compile("[:=]"), "access": re.compile("AKIA"), "hex": re.compile("[0-9a-f]{32}")}
#: The most unseen blobs whose list, of some 100 bytes each, is sent to where the texts lie.
FEW_BLOBS = 1 << 12
LEDGER = "blob binary, rule string, version int"
FINDINGS = f"{LEDGER}, starts array<int>, ends array<int>"


def spans_of(text: str, rule: Rule) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches long enough; offsets in code points, end exclusive."""
    if rule.kind in MARKS and not MARKS[rule.kind].search(text):
        return []
    return [m.span() for m in re.finditer(rule.pattern, text) if len(m[rule.group]) >= rule.least]


def blob_of(text: Column) -> Column:
    """The content address; a null text is the empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: str | None = None) -> DataFrame:
    """Findings (blob, rule, version, starts, ends), a row for each triple that the ledger lacks, empty lists included.

    docs: doc_id (any type, the path or its version) and text; ledger: (blob, rule, version) of earlier scans, whose
    findings the caller keeps. Appending the returned rows to the ledger makes the next scan skip them. Repeated rows
    and copies are scanned once; an empty table gives no rows. path: where the rows are written, a table of the
    application's without one.
    """
    rid = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    texts = docs.select(blob_of(F.col("text")).alias("blob"), rid.alias("rid"), F.coalesce("text", F.lit("")).alias("text"))
    blobs = texts.select("blob", "rid").groupBy("blob").agg(F.min("rid").alias("rid"))
    if ledger is not None:
        want = F.explode(F.array(*(F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules)))
        pairs = blobs.select("blob", "rid", want.alias("r")).select("blob", "rid", "r.rule", "r.version")
        lacking = pairs.join(ledger.select("blob", "rule", "version"), ["blob", "rule", "version"], "left_anti")
        blobs = lacking.groupBy("blob", "rid").agg(F.collect_set("rule").alias("todo"))
    else:
        blobs = blobs.withColumn("todo", F.array(*(F.lit(r.kind) for r in rules)))
    todo = packed(blobs)

    def find(blob, text, todo):
        seen = set()
        for b, t, names in zip(blob, text, todo, strict=True):
            if b in seen:  # repeated rows stand together after the join
                continue
            seen.add(b)
            for r in rules:
                if r.kind in names:
                    at = spans_of(t, r)
                    yield b, r.kind, r.version, [s for s, _ in at], [e for _, e in at]

    meet = todo.hint("broadcast" if todo.count() <= FEW_BLOBS else "shuffle_hash")
    found = packed(map_rows(texts.join(meet, ["blob", "rid"]).select("blob", "text", "todo"), find, FINDINGS), path)
    discard(todo)
    return found


class Ledger:
    """Findings of all versions scanned so far, a folder of one Parquet table a commit; a commit is there when it is whole.

    A ledger without a path of its own goes with the application's tables.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{tables_dir(spark)}/ledger-{uuid.uuid4().hex}"

    def commits(self) -> list[str]:
        at, store = _hadoop(self.spark, self.path)
        if not store.exists(at):
            return []
        found = [str(f.getPath()) for f in store.listStatus(at) if f.getPath().getName().startswith("commit-")]
        return sorted(p for p in found if store.exists(_hadoop(self.spark, f"{p}/_SUCCESS")[0]))

    def findings(self) -> DataFrame:
        paths = self.commits()
        return self.spark.read.schema(FINDINGS).parquet(*paths) if paths else self.spark.createDataFrame([], FINDINGS)

    def add(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> int:
        """Scan what the ledger lacks of these versions, as a new commit; the number of triples scanned."""
        done = self.commits()
        return scan(docs, self.findings() if done else None, rules, f"{self.path}/commit-{len(done):06d}-{uuid.uuid4().hex}").count()


def scan_history(versions: Iterable[DataFrame], ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's findings after adding versions in order: later ones scan only blobs that no earlier one held."""
    for docs in versions:
        ledger.add(docs, rules)
    return ledger.findings()


def join_paths(docs: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`row`, the `keep` columns of every row of docs, with `spans`, an array of (start, rank, kind, end) by start, then rule order.

    Only findings of the rules' own versions count, however many versions or repeats findings holds. A blob that many
    paths share is a hot key only of this join of two written tables, which AQE splits.
    """
    current = F.create_map(*(x for r in rules for x in (F.lit(r.kind), F.lit(r.version))))
    findings = findings.where(current[F.col("rule")] == F.col("version"))
    rank = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))))
    one = F.arrays_zip("starts", "ends")
    listed = F.transform(one, lambda x: F.struct(x["starts"].alias("start"), rank[F.col("rule")].alias("rank"), F.col("rule").alias("kind"), x["ends"].alias("end")))
    hits = findings.where(F.size("starts") > 0).withColumn("spans", listed)
    per_blob = packed(hits.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans")))
    whole = F.struct(*(F.col(c) for c in keep)).alias("row")
    return docs.select(whole, blob_of(F.col("text")).alias("blob")).join(per_blob, "blob", "left").drop("blob")


def listing(spans: Column) -> Column:
    """kind:start:end, comma-joined; empty for none."""
    return F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","), F.lit(""))


def redact(docs: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each run of overlapping spans in `text` replaced by [REDACTED:kind], n_chars, if any, with it; rows without findings unchanged."""
    d = join_paths(docs, findings, rules, keep=tuple(docs.columns))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("row.text")

    def step(acc, s):
        gap = F.when(s["start"] >= acc["at"], F.concat(text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit("[REDACTED:"), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    def finish(acc):
        return F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text)))

    hit = F.col("spans").isNotNull()
    d = d.withColumn("clean", F.when(hit, F.aggregate("spans", zero, step, finish)).otherwise(text))
    row = F.col("row").withField("text", F.col("clean"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(hit, F.length("clean")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType))
    return d.select(row.alias("row")).select("row.*")


def _is(kind: str):
    return lambda span: span["kind"] == kind


def summary(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, findings by kind, the digest of the base spans and the listing of all spans.

    A null or empty text, or one without secrets, has no spans: counts of 0 and the digest of the empty listing. Repeated
    rows get equal rows, and an empty table gives none; further columns of docs are ignored, whatever their names.
    """
    base = [r.kind for r in RULES]
    d = join_paths(docs, findings).withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")))
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in base]
    digest = F.sha2(listing(F.filter("spans", lambda s: s["kind"].isin(base))).cast("binary"), 256)
    return d.select("row.doc_id", *counts, digest.alias("base_sha256"), listing(F.col("spans")).alias("spans"))
