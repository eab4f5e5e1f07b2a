"""Message tables: documents, conversations and templated orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.core.dims import dim, dim_sql
from assayer.core.session import read_table, spread
from assayer.functions.text import MESSAGE_LIMIT, MESSAGE_MINIMUM, masked, nfkc, trimmed
from assayer.packs import templates


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents as messages."""
    return spread(
        read_table(spark, folder, "documents").select(
            F.col("doc_id").alias("msg_id"), "text", "lang", "source"
        )
    )


def templated(spark: SparkSession, folder: str) -> DataFrame:
    """One message per order, filled from its key, price and customer."""
    rows = templates.rows()
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    forms = dim(spark, templates.COLUMNS, rows).withColumnRenamed("text", "form")
    keyed = spread(orders, narrow=True).withColumn(
        "template_id", F.pmod(F.col("o_orderkey"), F.lit(len(rows))).cast("int")
    )
    key, price = F.col("o_orderkey"), F.floor("o_totalprice")
    fills: dict[str, Column] = {
        "{amt}": price,
        "{fee}": F.floor(price / 50) + 99,
        "{triple}": price * 3,
        "{pct}": key % 60 + 1,
        "{days}": key % 28 + 2,
        "{otp}": F.lpad((key * 7919 % 1000000).cast("string"), 6, "0"),
        "{phone}": F.concat(F.lit("9"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")),
        "{card}": F.concat(F.lit("4000"), F.lpad(key.cast("string"), 12, "0")),
    }
    text = F.col("form")
    for name, value in fills.items():
        text = F.replace(text, F.lit(name), value.cast("string"))
    return keyed.join(forms, "template_id").select(
        key.alias("msg_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"),
        "template_id", "pair_id", F.floor(key / len(rows)).alias("round_id"),
        "theme", "lang", "expected", "purpose", text.alias("text"),
    )


def templated_sql() -> str:
    rows = templates.rows()
    n = len(rows)
    fills = [
        ("{amt}", "CAST(floor(o_totalprice) AS BIGINT)"),
        ("{fee}", "CAST(floor(floor(o_totalprice) / 50) AS BIGINT) + 99"),
        ("{triple}", "CAST(floor(o_totalprice) AS BIGINT) * 3"),
        ("{pct}", "o_orderkey % 60 + 1"),
        ("{days}", "o_orderkey % 28 + 2"),
        ("{otp}", "lpad(CAST(o_orderkey * 7919 % 1000000 AS VARCHAR), 6, '0')"),
        ("{phone}", "'9' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')"),
        ("{card}", "'4000' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')"),
    ]
    text = "f.text"
    for name, value in fills:
        text = f"replace({text}, '{name}', CAST({value} AS VARCHAR))"
    return (
        f"SELECT o_orderkey AS msg_id, o_custkey AS user_id, o_orderdate AS ts, f.template_id, f.pair_id, "
        f"o_orderkey // {n} AS round_id, f.theme, f.lang, f.expected, f.purpose, {text} AS text "
        f"FROM orders JOIN ({dim_sql(templates.COLUMNS, rows)}) f ON f.template_id = o_orderkey % {n}"
    )


def conversations(spark: SparkSession, folder: str, limit: int = MESSAGE_LIMIT) -> DataFrame:
    """One message per conversation: distinct non-blank turns in first-seen order.

    Share intake bounds a message to ``limit`` characters and reports what was
    cut. A part takes at least one character and its separator two, so parts past
    ``limit / 3`` can never show, nor what lies past ``limit`` inside a part;
    cutting both first keeps even a conversation with a large share of all turns
    from gathering in one task.
    """
    turns = read_table(spark, folder, "conversations").select(
        "conv_id", "turn", trimmed(F.replace(F.col("text"), F.lit("\x00"), F.lit(""))).alias("part")
    )
    parts = turns.where(F.col("part") != "").groupBy("conv_id", "part").agg(F.min("turn").alias("turn"))
    sizes = parts.groupBy("conv_id").agg(
        F.count("*").alias("n_parts"), (F.sum(F.length("part")) + 2 * (F.count("*") - 1)).alias("total")
    )
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "part"))
    shown = (
        parts.withColumn("_rank", rank).where(F.col("_rank") <= limit // 3 + 1)
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("_rank", F.substring("part", 1, limit).alias("part")))).alias("parts"))
        .select("conv_id", F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("whole"))
    )
    return sizes.join(shown, "conv_id").select(
        "conv_id", "n_parts", "total", F.substring("whole", 1, limit).alias("text"),
        (F.col("total") > limit).alias("truncated"),
    )


def row_digests(df: DataFrame, key: str) -> DataFrame:
    """SHA-256 of each row's canonical JSON: fields in name order."""
    return df.select(key, F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("digest"))


def prepared(rows: DataFrame) -> DataFrame:
    """Intake of messages (msg_id, lang, text), for batches and streams alike.

    Text is normalised, trimmed and masked before it is bounded, so that the bound
    never leaves half of a secret; size and status speak of the trimmed text.
    """
    whole = rows.select("msg_id", "lang", trimmed(nfkc(F.col("text"))).alias("whole"))
    size = F.length("whole")
    return whole.select(
        "msg_id", "lang", F.substring(masked(F.col("whole")), 1, MESSAGE_LIMIT).alias("text"), size.alias("n_chars"),
        intake_status(size).alias("status"),
    )


def intake_status(size: Column) -> Column:
    return F.when(size < MESSAGE_MINIMUM, "too short").when(size > MESSAGE_LIMIT, "too long").otherwise("kept")


# Label fields of every known shape; a path leads to the field inside an item.
_ITEM_FIELDS = [
    ("id", "string"), ("pairId", "string"), ("language", "string"), ("group", "string"), ("text", "string"),
    ("expectAttention", "boolean"), ("expectedAttention", "boolean"), ("scored", "boolean"), ("riskIntent", "string"),
]
_NESTED_FIELDS = {"expected": [("minAttention", "int"), ("maxFindings", "int")], "annotation": [("group", "string")]}


def json_messages(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Labelled messages from JSON documents, one per file or (``whole_files`` off) one per line.

    The root is a list, or an object whose list is ``items``, else ``cases``, else its
    first list in the order of the document; empty lists are passed over. Documents
    are read as ``VARIANT``, so fields may come and go and change their type: one
    that does not fit its column is null. A document that is not JSON, or holds no
    list, is an error, as its messages would else be lost unseen.
    """
    raw = spark.read.text(path, wholetext=whole_files)
    if not whole_files:
        raw = raw.where(F.trim("value") != "")
    documents = raw.select(
        F.input_file_name().alias("file"), F.parse_json("value").alias("doc"), F.json_object_keys("value").alias("names")
    )
    fields = F.col("doc").try_cast("map<string,variant>")

    def filled(value: Column) -> Column:
        rows = value.try_cast("array<variant>")
        return F.when(F.size(rows) > 0, rows)

    lists = F.filter(F.transform("names", lambda name: filled(F.element_at(fields, name))), lambda rows: rows.isNotNull())
    some = F.coalesce(
        F.col("doc").try_cast("array<variant>"), filled(F.try_element_at(fields, F.lit("items"))),
        filled(F.try_element_at(fields, F.lit("cases"))), F.get(lists, 0),
    )
    has_list = F.exists("names", lambda name: F.element_at(fields, name).try_cast("array<variant>").isNotNull())
    none = F.when(has_list, F.array().cast("array<variant>")).otherwise(
        F.raise_error(F.concat(F.lit("no list of messages in "), F.col("file"))).cast("array<variant>")
    )
    rows = documents.select("file", F.explode(F.coalesce(some, none)).alias("row"))

    def read(field: str, kind: str, below: str = "") -> Column:
        return F.try_variant_get("row", f"${below}.{field}", kind).alias(field)

    return rows.select(
        "file", *[read(*field) for field in _ITEM_FIELDS],
        *[F.struct(*[read(*field, f".{name}") for field in inner]).alias(name) for name, inner in _NESTED_FIELDS.items()],
    )


def write_json_sets(items: DataFrame, path: str, per_set: int = 200) -> None:
    """Write items as JSON message sets, one per line, their roots in all four shapes in turn.

    A set takes ``per_set`` neighbouring rows of one task, so no key gathers more.
    """
    number = F.monotonically_increasing_id()
    sets = items.select(F.floor(number / per_set).alias("set"), F.struct(*items.columns).alias("item"))
    listed = sets.groupBy("set").agg(F.collect_list("item").alias("items"))
    rows, nothing = F.col("items"), F.array().cast("array<string>")
    shapes = [
        F.to_json(rows),
        F.to_json(F.struct(F.lit(1).alias("version"), rows.alias("items"))),
        F.to_json(F.struct(nothing.alias("items"), rows.alias("cases"))),
        F.to_json(F.struct(F.lit("set").alias("title"), rows.alias("messages"), F.array(F.lit("x")).alias("appendix"))),
    ]
    text = F.get(F.array(*shapes), F.pmod(F.col("set"), F.lit(len(shapes))).cast("int"))
    listed.select(text.alias("value")).write.mode("overwrite").text(path)


def harmonised_label(df: DataFrame) -> Column:
    """One boolean from the label shapes in use; null when a row is unlabelled."""
    have = set(df.columns)

    def col(name: str) -> Column:
        return F.col(f"`{name}`") if name in have else F.lit(None)

    group, scored = col("group"), col("scored")
    ceiling = F.col("expected.maxFindings") if "expected" in have else F.lit(None)
    noted = F.col("annotation.group") if "annotation" in have else F.lit(None)
    return F.coalesce(
        col("expectAttention"),
        col("expectedAttention"),
        F.when(col("riskIntent") != "", col("riskIntent") == "strong-scam-signals"),
        F.when(scored.cast("boolean") == F.lit(False), F.lit(None).cast("boolean"))
        .when(group.isin("scam", "attention", "offer"), True)
        .when(group == "benign", F.when(ceiling.isNull() | (ceiling == 0), False))
        .when(ceiling == 0, False),
        F.when(noted == "observable-risk-cue", True).when(noted == "no-attention-cue", False),
    )
