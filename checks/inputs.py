"""Feed-shaped inputs that Spark derives from the driver tables, whole tables each time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.durable import checkpointed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Fixed values shared with the SQL side
CSV_HEADERS = {
    "BUILDING": "IP地址,端口,TLS,下载速度(KB/s),城市,数据中心",
    "MACHINERY": "ip,port,tls,speed (mb/s),city,idc",
    "AUTOMOBILE": "IP,Port,TLS,Download Speed,City,Country",
    "FURNITURE": "ip address, port , tls,country,speed,city",
    "HOUSEHOLD": "ip,port,speed kb/s",
}
ROUTE_IDS = ", ".join(
    f"00000000-0000-1000-8000-00000000{lang.encode().hex()}" for lang in ("en", "fr", "de", "es")
)


def page_parts(pages: DataFrame) -> DataFrame:
    """``page_id, scheme, host, rest, path, query, lang`` of each page address."""
    url = F.col("url")
    rest = F.regexp_extract(url, r"^\w+://[^/]+(.*)$", 1)
    return pages.select(
        "page_id",
        "url",
        F.regexp_extract(url, r"^(\w+)://", 1).alias("scheme"),
        F.regexp_extract(url, r"^\w+://([^/]+)", 1).alias("host"),
        rest.alias("rest"),
        F.regexp_extract(rest, r"^([^?#]*)", 1).alias("path"),
        F.regexp_extract(rest, r"^/(\w+)/", 1).alias("lang"),
    )


def endpoint_lines(pages: DataFrame) -> DataFrame:
    """One endpoint line per page, in five shapes."""
    p = page_parts(pages)
    number, host = F.col("page_id").cast("string"), F.col("host")
    port = (F.col("page_id") % 50000 + 8000).cast("string")
    speed = F.concat((F.col("page_id") % 90).cast("string"), F.lit(".5 MB/s"))
    shape = F.col("page_id") % 5
    line = (
        F.when(shape == 0, F.concat(host, F.lit(":"), port, F.lit("#page "), number, F.lit(" "), speed))
        .when(shape == 1, F.concat(host, F.lit("#"), F.col("lang")))
        .when(shape == 2, F.concat(F.lit("[2001:db8::"), F.hex("page_id"), F.lit("]:"), port, F.lit("#v6")))
        .when(shape == 3, F.concat(host, F.col("rest")))
        .otherwise(F.concat(F.lit("192.0.2."), (F.col("page_id") % 256).cast("string"), F.lit(" and more")))
    )
    return p.select(
        F.lit(0).alias("source_ord"), F.col("page_id").alias("line_no"), line.alias("line")
    )


def link_lines(pages: DataFrame) -> DataFrame:
    """One link per page: with and without user, port and tag; some broken, some skipped."""
    p = page_parts(pages)
    n = F.col("page_id")
    number = n.cast("string")
    line = F.concat(
        F.when(n % 11 == 0, "ssr").otherwise(F.col("scheme")),
        F.lit("://"),
        F.when(n % 2 == 0, F.concat(F.lit("u"), number, F.lit("@"))).otherwise(""),
        F.col("host"),
        F.when(n % 3 < 2, F.concat(F.lit(":"), (n % 60000 + 1).cast("string"))).otherwise(""),
        F.regexp_extract("rest", r"^([^#]*)", 1),
        F.when(n % 4 == 1, F.concat(F.lit("#caf%C3%A9%20+"), F.col("lang")))
        .when(n % 4 == 2, F.lit("#bad%zz"))
        .when(n % 4 == 3, F.lit("#"))
        .otherwise(""),
    )
    return p.select(F.lit(0).alias("source_ord"), n.alias("line_no"), line.alias("line"))


def json_links(customer: DataFrame) -> DataFrame:
    """Links whose authority is base64 of a JSON object; of ten, one has text after the object,
    one a port that is no JSON and one no end."""
    obj = F.to_json(
        F.struct(
            F.concat(F.lit("h"), F.col("c_custkey"), F.lit(".example")).alias("add"),
            (F.col("c_custkey") % 60000 + 1).alias("port"),
            F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("ps"),
        )
    )
    tenth = F.col("c_custkey") % 10
    obj = (
        F.when(tenth == 7, F.concat(obj, F.lit(" junk")))
        .when(tenth == 8, F.regexp_replace(obj, r'"port":\d+', '"port":NaN'))
        .when(tenth == 9, F.rtrim(obj, F.lit("}")))
        .otherwise(obj)
    )
    body = F.regexp_replace(F.base64(obj.cast("binary")), r"\s", "")
    unpadded = F.rtrim(F.translate(body, "+/", "-_"), F.lit("="))
    shown = F.when(F.col("c_mktsegment") == "BUILDING", unpadded).otherwise(body)
    return customer.select(
        F.col("c_custkey").alias("line_no"), F.concat(F.lit("vmess://"), shown).alias("line")
    )


def csv_lines(customer: DataFrame) -> DataFrame:
    """A CSV feed per nation; customers with a low balance bring a new header along."""
    number = F.col("c_custkey")
    text = number.cast("string")
    balance = F.col("c_acctbal").cast("string")
    header = F.lit(None).cast("string")
    for segment, line in CSV_HEADERS.items():
        header = F.when(F.col("c_mktsegment") == segment, line).otherwise(header)
    data = F.concat_ws(
        ",",
        F.concat(F.lit("192.0.2."), text),
        F.when(number % 3 == 0, " ").otherwise((number % 60000 + 1000).cast("string")),
        F.when(number % 5 == 0, "FALSE").otherwise(" True"),
        F.when(F.col("c_acctbal") < 0, "n/a")
        .when(F.col("c_acctbal") > 8000, F.concat(balance, F.lit(" KB/s")))
        .when(F.col("c_acctbal") > 6000, F.concat(balance, F.lit("mb/s")))
        .otherwise(balance),
        F.when(number % 4 == 0, "").otherwise(F.col("c_mktsegment")),
        F.concat("c_name", F.lit("\r")),
    )
    brought = F.when(F.col("c_acctbal") < 1000, F.array(header, F.lit(" "), data)).otherwise(
        F.array(data)
    )
    return customer.select(
        F.col("c_nationkey").alias("source"), number.alias("_n"), F.posexplode(brought).alias("_at", "line")
    ).select(
        "source",
        (F.col("_n") * 4 + F.when(F.col("line").contains("192.0.2."), 2).otherwise(F.col("_at"))).alias("line_no"),
        "line",
    )


def included_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that include lists: customer, order, part, supplier, nation and region."""
    t = lambda name: table(spark, sf_dir, name)
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))

    def rows(df: DataFrame, list_id: Column, line_no: Column, line: Column) -> DataFrame:
        return df.select(
            list_id.alias("list_id"), line_no.cast("bigint").alias("line_no"), line.alias("line")
        )

    def call(kind: str, key: str) -> Column:
        return F.concat(F.lit("api://"), name(kind, key))

    zero, place = F.lit(0), lambda key: F.col(key) + 1
    part_suppliers = t("lineitem").select("l_partkey", "l_suppkey").distinct()
    order_parts = t("lineitem").select("l_orderkey", "l_partkey")
    pieces = [
        rows(t("customer"), name("c", "c_custkey"), zero, F.col("c_name")),
        rows(t("orders"), name("c", "o_custkey"), place("o_orderkey"), call("o", "o_orderkey")),
        rows(t("orders"), name("o", "o_orderkey"), zero, F.col("o_orderpriority")),
        rows(order_parts, name("o", "l_orderkey"), place("l_partkey"), call("p", "l_partkey")),
        rows(t("part"), name("p", "p_partkey"), zero, F.col("p_name")),
        rows(part_suppliers, name("p", "l_partkey"), place("l_suppkey"), call("s", "l_suppkey")),
        rows(t("supplier"), name("s", "s_suppkey"), zero, F.col("s_name")),
        rows(t("supplier"), name("s", "s_suppkey"), F.lit(1), call("n", "s_nationkey")),
        rows(t("nation"), name("n", "n_nationkey"), zero, F.col("n_name")),
        rows(t("nation"), name("n", "n_nationkey"), F.lit(1), call("r", "n_regionkey")),
        rows(t("region"), name("r", "r_regionkey"), zero, F.col("r_name")),
        rows(t("nation"), name("r", "n_regionkey"), place("n_nationkey"), call("n", "n_nationkey")),
    ]
    lists = pieces[0]
    for piece in pieces[1:]:
        lists = lists.unionByName(piece)
    # The lists land once, as a table, and are read from there.
    return checkpointed(lists)


def segment_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One root per market segment: a line of its own, then its customers' lists."""
    customer = table(spark, sf_dir, "customer")
    own = customer.select("c_mktsegment").distinct()
    calls = F.concat(F.lit("api://c"), F.col("c_custkey").cast("string"))
    return own.select(
        F.col("c_mktsegment").alias("root"),
        F.lit(0).cast("bigint").alias("line_no"),
        F.concat(F.lit("segment "), F.col("c_mktsegment")).alias("line"),
    ).unionByName(
        customer.select(
            F.col("c_mktsegment").alias("root"),
            (F.col("c_custkey") + 1).alias("line_no"),
            calls.alias("line"),
        )
    )


def feed_lists(pages: DataFrame, customer: DataFrame) -> DataFrame:
    """Landed lists: endpoint lines per language, the CSV files and the providers."""
    number = F.col("page_id")
    by_lang = page_parts(pages).select("page_id", F.concat(F.lit("lang/"), "lang").alias("list_id")).join(
        endpoint_lines(pages), F.col("page_id") == F.col("line_no")
    )
    nations = customer.select("c_nationkey").distinct()
    providers = F.concat(F.lit("provider/"), number.cast("string"))
    return (
        by_lang.select("list_id", "line_no", "line")
        .unionByName(
            nations.select(
                F.lit("csv files").alias("list_id"),
                F.col("c_nationkey").cast("bigint").alias("line_no"),
                F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string")).alias("line"),
            )
        )
        .unionByName(
            pages.select(F.lit("providers").alias("list_id"), number.alias("line_no"), providers.alias("line"))
        )
    )


def text_setting(pages: DataFrame) -> DataFrame:
    """A setting that includes the list of each language, in alphabetical order."""
    lang = F.col("lang")
    return page_parts(pages).select("lang").distinct().select(
        F.lit("text").alias("root"),
        (F.ascii(lang) * 256 + F.ascii(F.substring(lang, 2, 1))).cast("bigint").alias("line_no"),
        F.concat(F.lit("api://lang/"), lang).alias("line"),
    )


def named_list(spark: SparkSession, name: str) -> DataFrame:
    """A setting of one line that includes one list."""
    return spark.range(1).select(
        F.lit("setting").alias("root"), F.col("id").alias("line_no"), F.lit(f"api://{name}").alias("line")
    )


def nation_files(customer: DataFrame) -> DataFrame:
    return csv_lines(customer).withColumn("source", F.concat(F.lit("nation/"), F.col("source").cast("string")))


def provider_bodies(pages: DataFrame) -> DataFrame:
    """One body per page, with its link and a comment line; every other one is base64."""
    link = F.replace("line", F.concat(F.lit("u"), F.col("line_no").cast("string"), F.lit("@")), F.lit("{user}@"))
    body = F.concat(F.lit("no link here\n"), link, F.lit("\n"))
    packed = F.base64(body.cast("binary"))
    return link_lines(pages).select(
        F.concat(F.lit("provider/"), F.col("line_no").cast("string")).alias("source"),
        F.when(F.col("line_no") % 2 == 0, packed).otherwise(body).alias("body"),
    )


def measured_events(events: DataFrame) -> DataFrame:
    """Events as records: keyed by type and user, with the value as a measure in the tag."""
    value = F.floor("value").cast("string")
    tag = F.when(F.col("event_type") == "error", F.concat(F.lit("user "), F.col("user_id"))).otherwise(
        F.concat(F.lit("speed "), value, F.lit(" MB/s"))
    )
    return events.select(
        F.col("event_type").alias("scheme"),
        F.col("user_id").cast("string").alias("host"),
        F.lit("443").alias("port"),
        tag.alias("tag"),
        F.col("event_id").alias("seq"),
    )
