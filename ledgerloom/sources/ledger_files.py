"""Ledger files (CSV, JSON, XML) to one raw record shape, all text, nothing inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import JSON_WRAPPERS, LEDGER_ALIASES, RECORD_KEYS, XML_ROW_TAGS
from ..functions.text import blank_to_null, first_filled, split_list
from ..session import cut

LIST_FIELDS = ("input_addresses", "output_addresses", "input_amounts", "output_amounts")
TEXT_FIELDS = [f for f in LEDGER_ALIASES if f not in LIST_FIELDS]
RAW_FIELDS = ["record_type", *LEDGER_ALIASES]


class FileFormatError(ValueError):
    """The file cannot be read as the format it claims."""


def _plain(name: str) -> str:
    return name.lower().replace("_", "").replace("-", "").replace(" ", "")


def record_kind(columns: list[str]) -> str:
    """WALLET, TX_CLASS or TRANSACTION, decided once per file from its column names."""
    have = {_plain(c) for c in columns}
    has_txid = bool(have & {"txid", "txhash", "transactionid"})
    if have & {"address", "walletaddress", "wallet"} and not (has_txid or "txid1" in have):
        return "WALLET"
    lists = set(LEDGER_ALIASES["input_addresses"][:3] + LEDGER_ALIASES["output_addresses"][:3])
    if has_txid and have & {"class", "label"} and not have & lists:
        return "TX_CLASS"
    return "TRANSACTION"


def _with_position(df: DataFrame) -> DataFrame:
    """File name and a rising position: the order that 'first' and 'last' refer to."""
    return df.withColumn("src_file", F.input_file_name()).withColumn("src_pos", F.monotonically_increasing_id())


def map_ledger_columns(df: DataFrame) -> DataFrame:
    """Resolve column aliases of a text table and emit raw records."""
    by_plain = {_plain(c): c for c in df.columns}
    kind = record_kind([c for c in df.columns if c not in ("src_file", "src_pos")])

    def pick(field: str) -> Column:
        found = [F.col(f"`{by_plain[a]}`") for a in LEDGER_ALIASES[field] if a in by_plain]
        return first_filled(*found) if found else F.lit(None).cast("string")

    out = {f: F.lit(None).cast("string") for f in TEXT_FIELDS}
    lists = {f: F.array().cast("array<string>") for f in LIST_FIELDS}
    if kind == "TRANSACTION":
        out.update({f: pick(f) for f in TEXT_FIELDS if f not in ("address", "class")})
        out["fee"] = F.coalesce(out["fee"], F.lit("0.0"))
        out["script_type"] = F.coalesce(out["script_type"], F.lit("P2PKH"))
        lists = {f: split_list(pick(f)) for f in LIST_FIELDS}
    else:
        key = "address" if kind == "WALLET" else "txid"
        out[key] = F.trim(F.coalesce(pick(key), F.lit("")))
        out["class"] = F.trim(F.coalesce(pick("class"), F.lit("3")))
    cells = {**out, **lists}
    return df.select(
        F.lit(kind).alias("record_type"),
        *[cells[f].alias(f) for f in LEDGER_ALIASES],
        "src_file",
        "src_pos",
    )


#: How cells are quoted, for whole files and for single records.
_CSV = {"escape": '"', "mode": "PERMISSIVE"}


def _quotes(value: str) -> Column:
    return F.length(value) - F.length(F.replace(F.col(value), F.lit('"')))


def _placed(spark: SparkSession, path, end: str, weight: Column) -> DataFrame:
    """(src_file, block, line, src_pos, value, weight, up_to, in_file): texts cut at `end`, in the order of the file by src_pos.

    up_to is the sum of weights up to and with this piece, in_file that of the file.
    """
    # places are kept, as they depend on how a read is split
    pieces = cut(
        spark.read.text(path, lineSep=end).select(
            F.col("_metadata.file_path").alias("src_file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
            "value",
            weight.cast("long").alias("weight"),
        )
    )
    # a block holds fewer pieces than bytes, so its first byte and the number of the piece make one rising place
    first = F.min("line").over(Window.partitionBy("src_file", "block"))
    return _running(pieces, "weight", "up_to", "in_file").withColumn("src_pos", F.col("block") + F.col("line") - first)


def _running(pieces: DataFrame, weight: str, name: str, total: str) -> DataFrame:
    """pieces with the sum of a column up to and with each piece of its file, and that of the whole file.

    Running sums inside each block of the file, and the sums of whole blocks before it: no window holds more than a block.
    """
    blocks = pieces.groupBy("src_file", "block").agg(F.sum(weight).alias("_held"))
    before = Window.partitionBy("src_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "src_file",
        "block",
        F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_so_far"),
        F.sum("_held").over(Window.partitionBy("src_file")).alias(total),
    )
    in_block = Window.partitionBy("src_file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    summed = pieces.join(blocks, ["src_file", "block"]).withColumn(name, F.col("_so_far") + F.sum(weight).over(in_block))
    return summed.drop("_so_far")


def csv_records(spark: SparkSession, path) -> DataFrame:
    """(src_file, src_pos, value): the records of CSV files whose quoted cells may hold line breaks.

    A break ends a record only after an even number of quotes. That number is a prefix sum over the lines of a file: running
    sums inside each block of the file, and the sums of whole blocks before it. So files stay split over tasks; a record that
    goes on is gathered by the place of its first line, also across blocks. src_pos rises with the order in the file.
    A file with an odd number of quotes has one that opens no cell: its lines are records as they are. Blank records are left out.
    """
    counted = _placed(spark, path, "\n", _quotes("value")).select(
        "src_file",
        "block",
        "line",
        "src_pos",
        "value",
        F.col("weight").alias("quotes"),
        ((F.col("in_file") % 2 == 1) | ((F.col("up_to") - F.col("weight")) % 2 == 0)).alias("is_start"),
        (F.col("in_file") % 2 == 1).alias("unpaired"),
    )
    up_to = Window.partitionBy("src_file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("src_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    started = cut(counted.withColumn("start", F.max(F.when(F.col("is_start"), F.col("src_pos"))).over(up_to)))
    # a line before the first start of its block belongs to the last start of an earlier block
    last = started.groupBy("src_file", "block").agg(F.max("start").alias("last"))
    carried = last.select("src_file", "block", F.max("last").over(before).alias("carried"))
    alone = F.col("unpaired") | (F.col("is_start") & (F.col("quotes") % 2 == 0))
    whole = started.filter(alone).select("src_file", "src_pos", "value")
    parts = (
        started.filter(~alone)
        .join(carried, ["src_file", "block"])
        .groupBy("src_file", F.coalesce("start", "carried").alias("start"))
        .agg(F.sort_array(F.collect_list(F.struct("src_pos", "value"))).alias("parts"))
        .select("src_file", F.col("start").alias("src_pos"), F.array_join("parts.value", "\n").alias("value"))
    )
    return whole.union(parts).withColumn("value", F.rtrim("value", F.lit("\r"))).filter(F.trim("value") != "")


def _has_quoted_breaks(spark: SparkSession, path) -> bool:
    """Whether any line holds an odd number of quotes."""
    return not spark.read.text(path, lineSep="\n").filter(_quotes("value") % 2 == 1).isEmpty()


def _column_names(spark: SparkSession, head: str) -> list[str]:
    """The cells of a header; empty and repeated names take their number, as in Spark's reader."""
    one = spark.range(1)
    width = len(T.DataType.fromDDL(one.select(F.schema_of_csv(F.lit(head), _CSV)).first()[0]))
    cells = one.select(F.from_csv(F.lit(head), ", ".join(f"c{i} string" for i in range(width)), _CSV)).first()[0]
    lower = [(c or "").lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if lower.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def _read_broken_csv(spark: SparkSession, path) -> DataFrame:
    records = cut(csv_records(spark, path))
    heads = records.groupBy("src_file").agg(F.min_by("value", "src_pos").alias("head"), F.min("src_pos").alias("head_pos"))
    first = heads.orderBy("src_file").first()
    if first is None:
        raise FileFormatError(f"no columns in {path}")
    names = _column_names(spark, first.head)
    cells = F.from_csv("value", ", ".join(f"`{n.replace('`', '``')}` string" for n in names), _CSV)
    body = records.join(heads.select("src_file", "head_pos"), "src_file").filter("src_pos > head_pos")
    return body.select(cells.alias("cells"), "src_file", "src_pos").select("cells.*", "src_file", "src_pos")


def read_ledger_csv(spark: SparkSession, path, quoted_breaks: bool | None = None) -> DataFrame:
    """Rows of CSV files; cells in quotes may hold line breaks (csv_records).

    Files without such breaks take Spark's reader as it is. quoted_breaks says which they are; None looks for a line
    with an odd number of quotes, one more pass over the text.
    """
    if _has_quoted_breaks(spark, path) if quoted_breaks is None else quoted_breaks:
        return map_ledger_columns(_read_broken_csv(spark, path))
    raw = spark.read.option("header", True).options(**_CSV).csv(path)
    if not raw.columns:
        raise FileFormatError(f"no columns in {path}")
    return map_ledger_columns(_with_position(raw))


def _record_schema() -> T.StructType:
    names = dict.fromkeys(k for keys in RECORD_KEYS.values() for k in keys)
    return T.StructType([T.StructField(k, T.StringType()) for k in names])


def _truthy(field: str, prefix: str = "") -> Column:
    """First key that is present and not empty."""
    keys = [F.col(prefix + k) for k in RECORD_KEYS[field]]
    return F.coalesce(*[F.when(~F.trim(k).isin("", "[]"), k) for k in keys])


def _map_records(df: DataFrame, as_list) -> DataFrame:
    cells = {f: F.lit(None).cast("string") for f in LEDGER_ALIASES}
    cells.update({f: _truthy(f) for f in RECORD_KEYS if f not in LIST_FIELDS})
    cells["fee"] = F.coalesce(cells["fee"], F.lit("0.0"))
    cells["script_type"] = F.coalesce(cells["script_type"], F.lit("P2PKH"))
    cells.update({f: as_list(_truthy(f)) for f in LIST_FIELDS})
    return df.select(
        F.lit("TRANSACTION").alias("record_type"),
        *[cells[f].alias(f) for f in LEDGER_ALIASES],
        "src_file",
        "src_pos",
    )


def json_layout(spark: SparkSession, path) -> str:
    """'array', 'lines' or 'wrapped', from the first line that holds text."""
    head = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    if not head:
        raise FileFormatError(f"empty JSON file: {path}")
    first = head[0].value.strip()
    if first.startswith("["):
        return "array"
    probe = spark.range(1).select(
        F.json_object_keys(F.lit(first)).alias("keys"),
    ).first()
    is_record = probe.keys is not None and not set(probe.keys) & set(JSON_WRAPPERS[:3])
    return "lines" if is_record else "wrapped"


#: JSON arrays up to this many bytes are read as one document each, larger ones are cut into records first.
WHOLE_JSON_BYTES = 64 << 20


def json_array_records(spark: SparkSession, path) -> DataFrame:
    """(src_file, src_pos, value): the objects of top-level JSON arrays, in the order of the file, read by many tasks.

    Text is cut at each "}". Two prefix sums over places in the file say where a record ends: the number of quotes (is
    this brace inside a text?), then the depth of braces, with texts masked. A file that doesn't end with its array fails.
    """
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    pieces = _placed(spark, path, "}", F.length(bare) - F.length(F.replace(bare, F.lit('"'))))
    inside = lambda n: F.when(n % 2 == 1, F.lit('"')).otherwise(F.lit(""))
    outside = F.regexp_replace(F.concat(inside(F.col("up_to") - F.col("weight")), bare, inside(F.col("up_to"))), '"[^"]*"', "")
    # no brace ends the last piece of a file
    pieces = pieces.join(pieces.groupBy("src_file").agg(F.max("src_pos").alias("last")), "src_file")
    closes = (F.col("up_to") % 2 == 0) & (F.col("src_pos") < F.col("last"))
    opened = F.length(outside) - F.length(F.replace(outside, F.lit("{")))
    deep = cut(pieces.select("src_file", "block", "line", "src_pos", "value", closes.alias("closes"), (opened - closes.cast("int")).alias("step")))
    ended = (F.col("closes") & (F.col("depth") == 0)).cast("int")
    ends = cut(_running(deep, "step", "depth", "left_open").withColumn("end", ended).drop("left_open"))
    numbered = _running(ends, "end", "ended", "records").withColumn("number", F.col("ended") - F.col("end"))
    texts = (
        numbered.groupBy("src_file", "number")
        .agg(F.max("records").alias("records"), F.min("src_pos").alias("src_pos"), F.sort_array(F.collect_list(F.struct("src_pos", "value"))).alias("parts"))
        .select("src_file", "src_pos", (F.col("number") == F.col("records")).alias("is_tail"), F.array_join("parts.value", "}").alias("text"))
    )
    closed = F.col("text").rlike(r"^\s*(\[\s*)?\]\s*$")
    broken = F.raise_error(F.concat(F.lit("JSON array without an end: "), "src_file")).cast("boolean")
    kept = texts.filter(F.when(~F.col("is_tail"), True).when(closed, False).otherwise(broken))
    return kept.select("src_file", "src_pos", F.concat(F.regexp_replace("text", r"^[\s,\[]+", ""), F.lit("}")).alias("value"))


def read_ledger_json(spark: SparkSession, path, whole_up_to: int = WHOLE_JSON_BYTES) -> DataFrame:
    """Top-level array, wrapper object, or one object per line (bad lines are left out).

    One object per line splits over tasks, and so do arrays above whole_up_to bytes; smaller arrays are one document for
    each file. A wrapper is always one document.
    """
    record = _record_schema()
    layout = json_layout(spark, path)
    if layout == "lines":
        bad = T.StructField("_bad", T.StringType())
        parsed = F.from_json("value", T.StructType([*record, bad]), {"columnNameOfCorruptRecord": "_bad"})
        rows = spark.read.text(path).select(parsed.alias("r")).filter(F.col("r._bad").isNull()).select("r.*").drop("_bad")
        return _map_records(_with_position(rows), split_list)
    # a broken document fails its job instead of turning into nulls
    strict, document = {"mode": "FAILFAST"}, spark.read.text(path, wholetext=True)
    if layout == "array":
        largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
        if largest > whole_up_to:
            objects = json_array_records(spark, path).select(F.from_json("value", record, strict).alias("r"), "src_file", "src_pos")
            return _map_records(objects.select("r.*", "src_file", "src_pos"), split_list)
        rows = document.select(F.inline(F.from_json("value", T.ArrayType(record), strict)))
    else:
        wrappers = [T.StructField(w, T.ArrayType(record)) for w in JSON_WRAPPERS]
        whole = document.select(F.from_json("value", T.StructType([*wrappers, *record]), strict).alias("r")).select("r.*")
        itself = F.array(F.struct(*[F.col(f.name) for f in record]))
        rows = whole.select(F.inline(F.coalesce(*[F.col(w) for w in JSON_WRAPPERS], itself)))
    return _map_records(_with_position(rows), split_list)


def xml_row_tags(spark: SparkSession, path) -> list[str]:
    """The record tags that files hold, each way they are written, from one pass over the text."""
    found = F.regexp_extract_all("value", F.lit(rf"(?i)<({'|'.join(XML_ROW_TAGS)})(?=[\s>]|$)"), F.lit(1))
    tags = spark.read.text(path).select(F.explode(F.array_distinct(found)).alias("tag")).distinct()
    names = sorted(r.tag for r in tags.collect())  # the ways to write a few words
    if not names:
        raise FileFormatError(f"no transaction elements in {path}")
    return names


def _xml_chunks(spark: SparkSession, path) -> DataFrame:
    """(src_file, block, number, src_pos, ended, text): the text of each block of a file, cut after the ends of records.

    number counts the ends before a chunk in its block; only the last chunk of a block is not ended. A task reads its blocks
    in order and holds one record at a time; the end itself is left out.
    """
    end = rf"(?:{'|'.join(XML_ROW_TAGS)})\s*>".encode()

    def chunks(batches):
        import re

        import pyarrow as pa

        ends, names = re.compile(end, re.IGNORECASE), ["src_file", "block", "number", "src_pos", "ended", "text"]
        kinds = pa.schema(zip(names, [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()], strict=True))
        at, place, number, first, parts = None, 0, 0, 0, []
        for batch in batches:
            out = []
            for file, block, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (file, block):
                    if at is not None:
                        out.append((*at, number, at[1] + first, False, b"</".join(parts)))
                    at, place, number, first, parts = (file, block), 0, 0, 0, []
                if ends.match(value):
                    if parts:  # a block may begin with an end
                        out.append((*at, number, at[1] + first, True, b"</".join(parts)))
                    number, first, parts = number + 1, place, [value[value.index(b">") + 1 :]]
                else:
                    parts.append(value)
                place += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
        if at is not None:
            last = (*at, number, at[1] + first, False, b"</".join(parts))
            yield pa.RecordBatch.from_arrays([pa.array([c], k.type) for c, k in zip(last, kinds, strict=True)], schema=kinds)

    pieces = spark.read.text(path, lineSep="</").select(
        F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")
    )
    found = pieces.mapInArrow(chunks, "src_file string, block long, number long, src_pos long, ended boolean, text binary")
    return found.withColumn("text", F.col("text").cast("string"))


def xml_records(spark: SparkSession, path) -> DataFrame:
    """(src_file, src_pos, value): each record element of any of the record tags, whole, in the order of the file.

    Records that lie whole in a block stay where they are read. Only the first and the last chunk of a block are shuffled: the
    number of ends in earlier blocks names the record that they belong to. Record tags aren't nested.
    """
    tags = "|".join(XML_ROW_TAGS)
    chunks = _xml_chunks(spark, path)
    whole = chunks.filter("ended AND number > 0").select("src_file", "src_pos", "text")
    by_block = Window.partitionBy("src_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    edges = cut(chunks.filter("NOT ended OR number = 0"))  # at most two for each block, read twice
    blocks = edges.filter("NOT ended").select("src_file", "block", F.col("number").alias("_held"))
    blocks = blocks.select(
        F.col("src_file").alias("_file"),
        F.col("block").alias("_block"),
        F.coalesce(F.sum("_held").over(by_block), F.lit(0)).alias("_so_far"),
        F.sum("_held").over(Window.partitionBy("src_file")).alias("_in_file"),
    )
    edges = edges.join(blocks, (F.col("src_file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    spread = (
        edges.withColumn("number", F.col("number") + F.col("_so_far"))
        .filter(F.col("number") < F.col("_in_file"))
        .groupBy("src_file", "number")
        .agg(F.min("src_pos").alias("src_pos"), F.sort_array(F.collect_list(F.struct("src_pos", "text"))).alias("parts"))
        .select("src_file", "src_pos", F.array_join("parts.text", "</").alias("text"))
    )
    texts = whole.unionByName(spread)
    body = F.regexp_extract("text", rf"(?is)<({tags})((?:\s[^>]*)?>.*)$", 2)
    return texts.select("src_file", "src_pos", F.concat(F.lit("<record"), body, F.lit("</record>")).alias("value")).filter(body != "")


def _xml_list(text: Column) -> Column:
    """Child elements of any tag, or delimited text."""
    children = F.transform(F.regexp_extract_all(text, F.lit(r">([^<>]+)</"), F.lit(1)), lambda x: F.trim(x))
    return F.when(F.contains(text, F.lit("</")), F.filter(children, lambda x: x != "")).otherwise(split_list(text))


def read_ledger_xml(spark: SparkSession, path, row_tag: str | None = None) -> DataFrame:
    """Records under any of the record tags, in the order of the file. With one tag (given or found) Spark's reader cuts them."""
    tags = [row_tag] if row_tag else xml_row_tags(spark, path)
    if len(tags) > 1:
        parsed = F.from_xml("value", _record_schema(), {"rowTag": "record", "mode": "PERMISSIVE"})
        rows = xml_records(spark, path).select(parsed.alias("r"), "src_file", "src_pos").select("r.*", "src_file", "src_pos")
        return _map_records(rows, _xml_list)
    rows = (
        spark.read.format("xml").option("rowTag", tags[0]).option("mode", "PERMISSIVE").schema(_record_schema()).load(path)
    )
    return _map_records(_with_position(rows), _xml_list)


READERS = {"csv": read_ledger_csv, "json": read_ledger_json, "xml": read_ledger_xml}


def read_ledger(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    fmt = (fmt or path.rsplit(".", 1)[-1]).lower().strip()
    if fmt in ("ndjson", "jsonl"):
        fmt = "json"
    if fmt not in READERS:
        raise FileFormatError(f"unsupported format: {fmt}")
    return READERS[fmt](spark, path)


__all__ = [
    "FileFormatError",
    "RAW_FIELDS",
    "blank_to_null",
    "json_layout",
    "map_ledger_columns",
    "read_ledger",
    "read_ledger_csv",
    "read_ledger_json",
    "read_ledger_xml",
    "record_kind",
    "xml_row_tags",
]
