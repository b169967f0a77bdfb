"""Files of several layouts in one folder, and payloads whose shape varies.

Columns are found by name in a header that the file itself has, wherever it stands; every line is told with its file and number by Spark's readers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

C = F.col
# From this date on price files have the newer layout; the names in both; notations of dates and times in filings.
NEW_FROM = "2024-07-08"
PRICE_NAMES = {"symbol": ("SYMBOL", "TckrSymb"), "series": ("SERIES", "SctySrs"), "open": ("OPEN", "OpnPric"), "high": ("HIGH", "HghPric"), "low": ("LOW", "LwPric"), "close": ("CLOSE", "ClsPric"), "prev_close": ("PREVCLOSE", "PrvsClsgPric"), "volume": ("TOTTRDQTY", "TtlTradgVol"), "isin": ("ISIN", "ISIN")}
STAMPS = ("dd-MMM-yyyy HH:mm:ss", "dd-MMM-yyyy HH:mm", "dd-MMM-yyyy")
DAYS = ("dd-MMM-yyyy", "dd-MM-yyyy", "yyyy-MM-dd")
FLOW_DAYS = ("dd-MMM-yyyy", "dd/MM/yyyy", "yyyy-MM-dd", "dd-MM-yyyy")


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file, line, text) of every file of a folder; a file is read whole, so its lines keep their numbers. Meant for files of a day or a month."""
    d = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(C("_metadata.file_path"), "/"), -1).alias("file"), F.split("value", "\r?\n").alias("lines"))
    return d.select("file", F.posexplode("lines").alias("line", "text")).where(F.trim("text") != "")


def cells(text: Column) -> Column:
    """The trimmed cells of a line; quoted ones may hold commas."""
    quoted = F.regexp_extract_all(F.concat(text, F.lit(",")), F.lit(r'\s*("[^"]*"|[^,]*),'), 1)
    return F.transform(quoted, lambda x: F.regexp_replace(x, '^[\\s\ufeff"]+|[\\s"]+$', ""))


def by_header(lines: DataFrame, is_header: Column) -> DataFrame:
    """(file, line, row): each line below its file's first line that ``is_header`` (a condition on ``cells``) as a map from that header's names. Files without a header give nothing."""
    d = lines.withColumn("cells", cells(C("text")))
    head = d.where(is_header).groupBy("file").agg(F.min_by(F.struct("line", "cells"), "line").alias("h"))
    d = d.join(F.broadcast(head), "file").where(C("line") > C("h.line"))  # a row a file
    names, n = C("h.cells"), F.least(F.size("h.cells"), F.size("cells"))
    pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(names, i).alias("key"), F.element_at(C("cells"), i).alias("value")))
    first = F.filter(pairs, lambda p, i: (p["key"] != "") & (F.array_position(names, p["key"]) == i + 1))  # of columns with one name the first counts
    return d.select("file", "line", F.map_from_entries(first).alias("row"), C("h.cells").alias("header"))


def number(text: Column) -> Column:
    """A number with or without thousands commas; blanks, dashes and other text are null."""
    return F.trim(F.regexp_replace(text, ",", "")).try_cast("double")


def first_date(text: Column, formats: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)).cast("timestamp_ntz") for f in formats))


def daily_prices(lines: DataFrame, file_date: Column, targets: DataFrame | None = None, new_from: str = NEW_FROM) -> DataFrame:
    """(symbol, date, open, high, low, close, prev_close, volume, isin) of the EQ series in daily price files of both layouts.

    ``file_date`` gives a file's date, which decides its layout. Rows whose four prices aren't all numbers go; a missing volume is 0. Of a symbol's
    several rows on one day the last counts.
    """
    d = by_header(lines, F.array_contains("cells", "SYMBOL") | F.array_contains("cells", "TckrSymb")).withColumn("date", file_date)
    new = C("date") >= F.lit(new_from).cast("date")
    get = lambda k: F.when(new, C("row")[PRICE_NAMES[k][1]]).otherwise(C("row")[PRICE_NAMES[k][0]])
    prices = ["open", "high", "low", "close"]
    d = d.where(get("series") == "EQ").select("file", "line", get("symbol").alias("symbol"), "date", *(number(get(k)).alias(k) for k in [*prices, "prev_close"]), F.coalesce(F.floor(number(get("volume"))), F.lit(0)).alias("volume"), F.coalesce(get("isin"), F.lit("")).alias("isin"))
    d = d.dropna(subset=["symbol", "date", *prices])
    if targets is not None:
        d = d.join(targets.select("symbol").distinct(), "symbol", "left_semi")
    last = Window.partitionBy("symbol", "date").orderBy(F.desc("file"), F.desc("line"))
    return d.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "file", "line")


def net_open_interest(lines: DataFrame, file_date: Column, client: str = "FII") -> DataFrame:
    """(date, net): index futures long less short of a client type, from daily files with a title above the header. Files without the row or its numbers give nothing."""
    d = by_header(lines, F.array_contains("cells", "Client Type")).withColumn("date", file_date)
    d = d.where(F.trim(C("row")["Client Type"]) == client)
    d = d.withColumn("net", number(C("row")["Future Index Long"]) - number(C("row")["Future Index Short"]))
    return d.groupBy("date").agg(F.min_by("net", "line").alias("net")).where("date is not null and net is not null")


def flow_rows(lines: DataFrame) -> DataFrame:
    """(date, fii, dii) from flow files: columns by pattern in the header, the 4th and 7th where no name tells; rows without a date go, bad numbers are null."""
    d = by_header(lines, F.exists("cells", lambda x: F.lower(x).contains("date")))
    named = lambda pattern, place: F.coalesce(F.get(F.filter("header", lambda x: F.lower(x).rlike(pattern)), F.lit(0)), F.get("header", F.lit(place)) if place is not None else F.lit(None))
    day, fii, dii = named("date", None), named("fii.*net|net.*fii", 3), named("dii.*net|net.*dii", 6)
    d = d.withColumns({"_d": F.element_at("row", day), "_f": F.element_at("row", fii), "_i": F.element_at("row", dii)})
    return d.select(first_date(C("_d"), FLOW_DAYS).cast("date").alias("date"), number(C("_f")).alias("fii"), number(C("_i")).alias("dii")).where("date is not null")


def filing_events(payloads: DataFrame) -> DataFrame:
    """(symbol, ts, period_start, period_end, relating_to, audited, consolidated, financial_year, seq_number) from JSON payloads (text): a list of filings or an
    object with one under ``data``, in the older or the integrated form. Filings without a symbol or a time go."""
    old, new = ("broadCastDate", "fromDate", "toDate", "relatingTo", "financialYear", "seqNumber"), ("broadcast_Date", "qe_Date", "type_Sub", "seq_Id")
    kind = "struct<" + ", ".join(f"`{c}`: string" for c in ("symbol", "audited", "consolidated", *old, *new)) + ">"
    text = F.trim("text")
    listed = F.when(text.startswith("["), F.from_json(text, f"array<{kind}>")).otherwise(F.from_json(text, f"struct<data: array<{kind}>>")["data"])
    r = payloads.select(F.explode(listed).alias("r")).select("r.*")
    said = lambda *names: F.coalesce(*(F.trim(C(n)) for n in names), F.lit(""))
    d = r.select(
        said("symbol").alias("symbol"), F.coalesce(first_date(C("broadCastDate"), STAMPS), first_date(C("broadcast_Date"), STAMPS)).alias("ts"),
        first_date(C("fromDate"), DAYS).cast("date").alias("period_start"), F.coalesce(first_date(C("toDate"), DAYS), first_date(C("qe_Date"), DAYS)).cast("date").alias("period_end"),
        said("relatingTo", "type_Sub").alias("relating_to"), said("audited").alias("audited"), said("consolidated").alias("consolidated"), said("financialYear").alias("financial_year"), said("seqNumber", "seq_Id").alias("seq_number"),
    )
    return d.where((C("symbol") != "") & C("ts").isNotNull())


def put_call_values(payloads: DataFrame) -> DataFrame:
    """(date, pcr) from JSON of any of three shapes (date, text): a number, a list of objects, an object; in objects the first key that has pcr in its
    name and a value other than 0. Payloads that tell none go."""
    v = F.try_parse_json("text")
    shape = F.schema_of_variant(v)
    pairs = lambda x: F.map_entries(F.from_json(x, "map<string,string>"))
    objects = F.when(shape.startswith("ARRAY"), F.from_json("text", "array<string>")).when(shape.startswith("OBJECT"), F.array("text"))
    entries = F.flatten(F.transform(F.filter(objects, lambda x: F.trim(x).startswith("{")), pairs))
    told = F.filter(entries, lambda e: F.lower(e["key"]).contains("pcr") & F.coalesce(number(e["value"]) != 0, F.lit(False)))
    pcr = F.when(F.try_variant_get(v, "$", "double").isNotNull() & ~shape.startswith("OBJECT") & ~shape.startswith("ARRAY"), F.try_variant_get(v, "$", "double")).otherwise(number(F.get(told, F.lit(0))["value"]))
    return payloads.select("date", pcr.alias("pcr")).where("pcr is not null")


def fundamentals_row(payloads: DataFrame, preferences: dict[str, list[str]]) -> DataFrame:
    """(symbol, one double for each name in ``preferences``, fcf) from payloads (symbol, text) with ``keyMetrics`` (a list of key and value) and ``financials`` (a list of
    reports with type, period end and items).

    A metric is the first of its keys that has a number. Free cash flow is operating cash flow plus capital spending, of the latest annual report that has both.
    """
    kind = "struct<keyMetrics: array<struct<key: string, value: string>>, financials: array<struct<type: string, endDate: string, items: map<string, string>>>>"
    d = payloads.select("symbol", F.from_json("text", kind).alias("p"))
    of = lambda key: number(F.get(F.filter("p.keyMetrics", lambda m: (m["key"] == key) & number(m["value"]).isNotNull()), F.lit(0))["value"])
    annual = F.filter("p.financials", lambda f: (F.lower(f["type"]) == "annual") & number(f["items"]["operatingCashFlow"]).isNotNull() & number(f["items"]["capitalExpenditure"]).isNotNull())
    latest = F.element_at(F.array_sort(F.transform(annual, lambda f: F.struct(f["endDate"].alias("at"), (number(f["items"]["operatingCashFlow"]) + number(f["items"]["capitalExpenditure"])).alias("fcf")))), -1)
    return d.select("symbol", *(F.coalesce(*map(of, keys)).alias(name) for name, keys in preferences.items()), F.when(F.size(annual) > 0, latest["fcf"]).alias("fcf"))


def cash_tokens(instruments: DataFrame) -> DataFrame:
    """(name, token) of cash listings, from (row, token, symbol, name, exchange, kind): symbols that end in -EQ, the last row of a name counts; then
    indices by their name in upper case, the first row, where no listing has that name."""
    listed = instruments.where((C("exchange") == "NSE") & C("symbol").endswith("-EQ")).groupBy(F.regexp_replace("symbol", "-EQ$", "").alias("key")).agg(F.max_by("token", "row").alias("token"), F.lit("EQ").alias("kind"))
    index = instruments.where((C("kind") == "AMXIDX") & (C("name") != "") & C("exchange").isin("NSE", "BSE")).groupBy(F.upper("name").alias("key")).agg(F.min_by("token", "row").alias("token"), F.lit("AMXIDX").alias("kind"))
    return listed.unionByName(index.join(listed, "key", "left_anti")).withColumnRenamed("key", "name")


def underlyings(instruments: DataFrame) -> DataFrame:
    """(name, token) of stocks with futures and a cash listing; names of test contracts don't count."""
    futures = instruments.where((C("exchange") == "NFO") & (C("kind") == "FUTSTK") & (C("name") != "") & ~F.upper("name").contains("NSETEST")).select("name").distinct()
    return cash_tokens(instruments).where("kind = 'EQ'").join(futures, "name", "left_semi").select("name", "token")
