"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a path is addressed by the SHA-256 of its content. The
ledger has one row per blob and scan: which rule versions were applied and
which spans they found. A run scans only blobs with a rule version that the
ledger lacks, each blob once however many paths hold it, and joins findings
back to all paths. Raising a rule's version makes exactly that rule run again.

One path stands for each unseen blob; its text is met by a join on path and
blob, so neither a blob that a third of all paths share nor a path of many
versions meets more than its own rows, and no text is grouped. Findings exist for few blobs; the join from paths to findings holds
rows without text, whose skew adaptive execution splits.

Positions are code points, end exclusive. A match is found by splitting the
text at matches: the lengths of pieces and matches add up to positions, in
blocks of matches, so that a text of very many matches is not folded in
quadratic time.

Edge cases: a null text is empty, and is one blob with empty texts; null paths
are scanned like others; a path may have several versions; repeated rows of a
path each get a row; empty tables and ledgers work; other columns are ignored,
and ``mask`` carries them whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import Scratch, own_name


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches count if ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# Kinds in the order in which spans of one start are listed.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # runs shorter than 24 would be dropped, and a run is matched whole either way
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)

SPANS = "array<struct<start:int,place:int,kind:string,end:int,rule:string>>"
LEDGER = f"blob binary, rules array<string>, spans {SPANS}"
#: Matches folded at a time.
BLOCK = 128


def _let(value: Column, body) -> Column:
    """body(value) with the value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rule_spans(text: Column, rule: Rule, place: int) -> Column:
    """Spans of one rule: leftmost matches that do not overlap, too short ones dropped."""
    pieces = F.split(text, rule.pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["piece"])
        end = start + F.length(pair["match"])
        span = F.struct(
            start.alias("start"),
            F.lit(place).alias("place"),
            F.lit(rule.kind).alias("kind"),
            end.alias("end"),
            F.lit(rule.key).alias("rule"),
        )
        value = F.regexp_extract(pair["match"], rule.pattern, rule.group)
        return F.struct(
            end.alias("at"),
            F.when(F.length(value) >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    none = F.array().cast(SPANS)
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def block(pairs: Column) -> Column:
        """Each block's length and spans, counted from its start."""
        return F.transform(
            F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")),
            lambda k: F.aggregate(F.slice(pairs, k * BLOCK + 1, F.lit(BLOCK)), start, step),
        )

    def follow(acc: Column, b: Column) -> Column:
        moved = F.transform(
            b["spans"],
            lambda s: s.withField("start", s["start"] + acc["at"]).withField("end", s["end"] + acc["at"]),
        )
        return F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["parts"], F.array(moved)).alias("parts"))

    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
    whole = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("parts"))
    found = F.aggregate(_let(pairs, block), whole, follow, lambda acc: F.flatten(acc["parts"]))
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: str = "doc_id"):
    """(findings per path, rows to append to the ledger) for ``versions(path, text)``.

    Findings: the path, ``blob`` and ``spans`` of the given rule versions,
    ordered by start and then by the rules' order.
    """
    spark = versions.sparkSession
    scratch = Scratch(spark, "secrets")
    content = F.coalesce("text", F.lit(""))
    paths = scratch.keep(versions.select(path, F.unhex(F.sha2(content, 256)).alias("blob")), "paths")
    wanted = F.array(*[F.lit(r.key) for r in rules])
    blobs = paths.groupBy("blob").agg(F.min(path).alias(path))
    if ledger is None:
        unseen = blobs.withColumn("todo", wanted)
    else:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
        unseen = blobs.join(seen, "blob", "left").withColumn(
            "todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
        )
    unseen = unseen.where(F.size("todo") > 0).select(path, "blob", "todo")
    # a path may have several versions: its text must be the blob's
    texts = versions.select(F.col(path).alias("_path"), content.alias("_text"), F.unhex(F.sha2(content, 256)).alias("_blob"))
    found = [F.when(F.array_contains("todo", r.key), rule_spans(F.col("_text"), r, k)).otherwise(F.array().cast(SPANS)) for k, r in enumerate(rules)]
    scanned = texts.join(unseen, F.col("_path").eqNullSafe(F.col(path)) & (F.col("_blob") == F.col("blob"))).select(
        "blob", F.col("todo").alias("rules"), F.array_sort(F.concat(*found)).alias("spans")
    )
    fresh = scratch.keep(scanned.dropDuplicates(["blob"]), "ledger")
    whole = fresh if ledger is None else fresh.unionByName(ledger.select("blob", "rules", "spans"))
    # spans of a blob may come from several scans, of which older rule versions no longer count
    counted = (
        whole.where(F.size("spans") > 0)
        .select("blob", F.filter("spans", lambda s: F.array_contains(wanted, s["rule"])).alias("spans"))
        .groupBy("blob")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    )
    findings = paths.join(counted, "blob", "left").select(
        path, "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")
    )
    return findings, fresh


def append_ledger(fresh: DataFrame, folder: str) -> None:
    """Adds a run's rows to a ledger that is kept as Parquet."""
    fresh.write.mode("append").parquet(folder)


def redact(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every span replaced; overlapping spans become one mask."""

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return (
            F.when(s["start"] >= acc["at"], F.struct(F.concat(acc["out"], gap, F.lit(mask)).alias("out"), s["end"].alias("at")))
            .otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def mask(documents: DataFrame, ledger: DataFrame) -> DataFrame:
    """The documents with every span of a scan's ledger rows masked in the text and n_chars counted anew.

    Texts meet the ledger by content, so null and repeated ids lose nothing.
    """
    key, blob, spans = (own_name(n, documents) for n in ("key", "blob", "spans"))
    known = ledger.where(F.size("spans") > 0).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    keyed = documents.withColumn(key, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    met = keyed.join(known, F.col(key) == F.col(blob), "left")
    text = F.when(F.col(spans).isNotNull(), redact(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    size = F.when(F.col(spans).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return met.withColumn("text", text).withColumn("n_chars", size).select([F.col(f"`{c}`") for c in documents.columns])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, _ = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    listed = F.array_join(
        F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return findings.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans")
    )
