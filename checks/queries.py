"""One query per operator over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs as I
from feedloom.durable import scratch_path
from feedloom.functions import endpoint, ids, measure, payload, pool, text, uri
from feedloom.operators import cap, match, rank, routes, settings
from feedloom.plans import resolve
from feedloom.plans.feed import collect_records, ranked_feed
from feedloom.sinks import files, payloads
from feedloom.sources import csvfeed, includes, lines, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


# Sources


@query
def line_scan(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.scan_lines(docs, "text")


@query
def include_closure(spark, sf_dir):
    lists, roots = I.included_lists(spark, sf_dir), I.segment_roots(spark, sf_dir)
    return includes.expand_includes(lists, roots)


@query
def include_order(spark, sf_dir):
    lists, roots = I.included_lists(spark, sf_dir), I.segment_roots(spark, sf_dir)
    path = F.array_join(F.col("path").cast("array<string>"), "/")
    return includes.arrival_paths(lists, roots).select("root", "list_id", path.alias("path"))


@query
def include_one_level(spark, sf_dir):
    lists = I.included_lists(spark, sf_dir)
    orders = lists.filter(F.col("list_id").startswith("o")).withColumnRenamed("list_id", "root")
    return includes.expand_one_level(lists, orders).select("root", "list_id", "line")


@query
def drifting_csv(spark, sf_dir):
    feed = I.csv_lines(I.table(spark, sf_dir, "customer"))
    rows = csvfeed.csv_records(feed, csvfeed.CsvOptions.from_setting("5:8"))
    return rows.select("source", "line_no", "host", "port", "tag")


@query
def drifting_csv_uncapped(spark, sf_dir):
    feed = I.csv_lines(I.table(spark, sf_dir, "customer"))
    rows = csvfeed.csv_records(feed, csvfeed.CsvOptions.from_setting("5:0"))
    return rows.select("source", "line_no", "host", "port", "tag")


@query
def link_extract(spark, sf_dir):
    parsed = records.link_records(I.link_lines(I.table(spark, sf_dir, "pages")))
    return records.good(parsed).select("line_no", "scheme", "host", "port", "tag", "link")


@query
def json_link_extract(spark, sf_dir):
    parsed = records.link_records(I.json_links(I.table(spark, sf_dir, "customer")))
    return records.good(parsed).select("line_no", "scheme", "host", "port", "tag")


@query
def base64_sniff(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents")
    tokens = docs.select(F.explode(F.split("text", "[ \n]+")).alias("token")).distinct()
    return tokens.withColumn("is_base64", payload.is_base64(F.col("token")))


@query
def base64_decode(spark, sf_dir):
    raw = F.col("text").cast("binary")
    one_line = payload.encode_base64(raw)
    url_safe = F.rtrim(F.translate(one_line, "+/", "-_"), F.lit("="))
    shape = F.col("doc_id") % 4
    body = (
        F.when(shape == 0, one_line)
        .when(shape == 1, url_safe)
        .when(shape == 2, F.base64(raw))
        .otherwise(F.concat(F.lit("# "), F.col("text")))
    )
    plain = payload.plain_body(body)
    docs = I.table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.md5(plain.cast("binary")).alias("digest"), F.length(plain).alias("chars")
    )


@query
def rejects(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select("source", "text")
    refused = records.reject_counts(records.endpoint_records(lines.scan_lines(docs, "text")))
    links = records.link_records(I.link_lines(I.table(spark, sf_dir, "pages")))
    csv = csvfeed.csv_records(
        I.csv_lines(I.table(spark, sf_dir, "customer")), keep_rejects=True
    )
    return (
        refused.unionByName(records.reject_counts(links.withColumn("source", F.lit("links"))))
        .unionByName(records.reject_counts(csv.withColumn("source", F.col("source").cast("string"))))
    )


# Projections and scalar work


@query
def endpoint_parse(spark, sf_dir):
    parsed = records.endpoint_records(I.endpoint_lines(I.table(spark, sf_dir, "pages")))
    return records.good(parsed).select("line_no", "host", "port", "tag")


@query
def authority_parse(spark, sf_dir):
    number = F.col("c_custkey").cast("string")
    port = (F.col("c_custkey") % 60000 + 1).cast("string")
    host = F.concat(F.lit("h"), number, F.lit(".example"))
    login = F.when(
        F.col("c_acctbal") < 0, F.concat(host, F.lit(":"), port)
    ).otherwise(F.concat(F.lit("u"), number, F.lit(":p"), F.col("c_mktsegment"), F.lit("@"), host, F.lit(":"), port))
    relay = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("[2001:db8::"), F.hex("c_custkey"), F.lit("]:"), port))
        .when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("[2001:db8::"), F.hex("c_custkey"), F.lit("]")))
        .when(F.col("c_mktsegment") == "FURNITURE", host)
        .otherwise(F.concat(host, F.lit(":"), port))
    )
    parsed = I.table(spark, sf_dir, "customer").select(
        "c_custkey",
        endpoint.parse_login(login).alias("l"),
        endpoint.parse_relay(relay).alias("r"),
    )
    return parsed.select(
        "c_custkey",
        "l.user",
        "l.password",
        "l.host",
        "l.port",
        F.col("r.host").alias("relay_host"),
        F.col("r.port").alias("relay_port"),
    )


@query
def tag_compose(spark, sf_dir):
    customer = I.table(spark, sf_dir, "customer").join(
        I.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    city = F.when(F.col("c_acctbal") < 3000, "").otherwise(F.col("c_mktsegment"))
    country = F.when(F.col("c_acctbal") < 1000, "").otherwise(F.col("n_name"))
    idc = F.when(F.col("c_acctbal") >= 0, F.col("c_name"))
    address = F.concat(F.lit("192.0.2."), F.col("c_custkey"))
    return customer.select("c_custkey", measure.compose_tag(address, city, country, idc).alias("tag"))


@query
def port_default(spark, sf_dir):
    order = I.table(spark, sf_dir, "orders")
    port = F.when(F.col("o_orderstatus") == "F", "").when(
        F.col("o_orderstatus") == "O", F.col("o_custkey").cast("string")
    )
    tls = F.when(F.col("o_totalprice") > 200000, "TRUE").when(F.col("o_totalprice") > 100000, "no")
    return order.select("o_orderkey", measure.default_port(port, tls).alias("port"))


@query
def unit_normalise(spark, sf_dir):
    events = I.table(spark, sf_dir, "events")
    unit = (
        F.when(F.col("event_type") == "click", " kB/s")
        .when(F.col("event_type") == "view", "MB/s")
        .otherwise("")
    )
    cell = F.when(F.col("event_type") == "error", "none").otherwise(
        F.concat(F.col("value").cast("string"), unit)
    )
    number = measure.leading_number(cell)
    return events.select(
        "event_id",
        number.alias("number"),
        measure.unit_of(cell).alias("unit"),
        measure.to_mega(number, measure.unit_of(cell)).alias("mega"),
    )


@query
def measure_extract(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents")
    body = F.concat("text", F.lit(" "), F.col("n_chars").cast("string"), F.lit(".5 kb/s then 9 MB/s"))
    return docs.select(
        "doc_id",
        measure.tag_measure(body).alias("measure"),
        measure.tag_measure(body, unit_aware=True).alias("mega"),
    )


@query
def uri_build(spark, sf_dir):
    number = F.col("c_custkey").cast("string")
    host = F.concat(F.lit("h"), number, F.lit(".example"))
    built = uri.build_uri(
        F.lit("vless"),
        host,
        F.when(F.col("c_acctbal") >= 0, (F.col("c_custkey") % 60000 + 1).cast("string")),
        F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit("u:"), number)),
        {"type": F.lower("c_mktsegment"), "path": F.lit("/?ed=2 é~"), "host": host},
        F.concat("c_name", F.lit(' <é> "q"/%')),
    )
    return I.table(spark, sf_dir, "customer").select("c_custkey", built.alias("uri"))


@query
def token_replace(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents")
    replaced = text.replace_token(F.col("text"), "e.", "[$1]")
    return docs.select(
        "doc_id",
        F.md5(replaced.cast("binary")).alias("digest"),
        F.length(replaced).alias("chars"),
    )


@query
def route_class(spark, sf_dir):
    p = I.page_parts(I.table(spark, sf_dir, "pages"))
    number = F.col("page_id")
    id_path = F.concat(F.lit("/00000000-0000-1000-8000-00000000"), F.lower(F.hex("lang")))
    path = (
        F.when(number % 10 == 9, "//")
        .when(F.contains("rest", F.lit("?")), F.concat(id_path, F.lit("/")))
        .when(F.contains("rest", F.lit("#")), F.concat(id_path, F.lit("/x")))
        .otherwise(F.col("path"))
    )
    requests = p.select(
        "page_id",
        path.alias("path"),
        F.when(number % 4 == 1, "a=1&target=RAW")
        .when(number % 4 == 2, "raw")
        .when(number % 4 == 3, "sub=1&raw=1")
        .alias("query"),
        F.when(number % 7 == 0, "websocket").when(number % 7 == 1, "WebSocket").alias("upgrade"),
        F.when(number % 3 == 0, "Mozilla/5.0").when(number % 3 == 1, "curl").alias("user_agent"),
    )
    return routes.classify_requests(requests, F.lit(I.ROUTE_IDS)).select(
        "page_id", "matched_id", "route", "output"
    )


# Filters


@query
def arity_filter(spark, sf_dir):
    feed = I.csv_lines(I.table(spark, sf_dir, "customer"))
    rows = csvfeed.fits_header(csvfeed.fill_headers(feed))
    return rows.select("source", "line_no", "reason")


@query
def flag_filter(spark, sf_dir):
    feed = I.csv_lines(I.table(spark, sf_dir, "customer"))
    rows = csvfeed.tls_only(csvfeed.fits_header(csvfeed.fill_headers(feed)))
    return rows.filter(F.col("reason").isNull()).select("source", "line_no")


@query
def threshold_filter(spark, sf_dir):
    feed = I.csv_lines(I.table(spark, sf_dir, "customer"))
    rows = csvfeed.with_speed(csvfeed.fits_header(csvfeed.fill_headers(feed)))
    kept = csvfeed.fast_enough(rows, 50.0).filter(F.col("reason").isNull())
    return kept.select("source", "line_no", "speed")


@query
def id_list_validate(spark, sf_dir):
    shaped = lambda d: F.regexp_replace(
        d, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )
    docs = I.table(spark, sf_dir, "documents")
    first = shaped(F.md5(F.col("text").cast("binary")))
    second = F.upper(shaped(F.md5(F.concat("lang", F.col("doc_id").cast("string")).cast("binary"))))
    listed = (
        F.when(F.col("lang") == "fr", F.lit(" , \n"))
        .when(F.col("lang") == "de", F.concat(first, F.lit(" ,\t"), second))
        .otherwise(F.concat(first, F.lit(",,")))
    )
    checked = docs.select("doc_id", ids.valid_ids(listed).alias("c"))
    return checked.select("doc_id", F.size("c.ids").alias("n_ids"), F.col("c.valid").alias("valid"))


# Joins


@query
def first_contained(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "text")
    passages = I.table(spark, sf_dir, "benchmark").withColumnRenamed("text", "passage")
    found = match.first_contained(docs, "text", "doc_id", passages, "passage", "item_id")
    return found.select("doc_id", "item_id")


@query
def first_contained_long(spark, sf_dir):
    """Every document against a list too long to travel with the plan: benchmark words."""
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "text")
    words = I.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", "[ \n]+")).alias("at", "word"))
    listed = words.filter(F.length("word") >= 6).select("word", (F.col("item_id") * 100_000 + F.col("at")).alias("place"))
    return match.first_contained(docs, "text", "doc_id", listed, "word", "place").select("doc_id", "place")


@query
def allowlist_semi(spark, sf_dir):
    events = I.table(spark, sf_dir, "events").select("event_id", "user_id")
    solvent = I.table(spark, sf_dir, "customer").filter(F.col("c_acctbal") >= 4000)
    kept = match.allowed(events, "user_id", solvent, "c_custkey")
    out = match.refused(events, "user_id", solvent, "c_custkey")
    return kept.withColumn("kept", F.lit(True)).unionByName(out.withColumn("kept", F.lit(False)))


# Aggregation, windows, limits, set operations, order


@query
def keep_best(spark, sf_dir):
    events = I.measured_events(I.table(spark, sf_dir, "events"))
    return rank.keep_best(events).select("scheme", "host", "tag", "seq", "first_seq")


@query
def tag_ordinals(spark, sf_dir):
    events = I.measured_events(I.table(spark, sf_dir, "events"))
    return rank.accepted_records(events).select("seq", "scheme", "host", "tag", "tag_no")


def _keys_with_gaps(spark, sf_dir):
    """Events as records in which some hosts are null, some empty, and many ports null."""
    user = F.col("host").cast("bigint")
    return I.measured_events(I.table(spark, sf_dir, "events")).withColumns(
        {
            "host": F.when(user % 4 == 0, F.lit("")).when(user % 4 > 1, F.col("host")),
            "port": F.when(F.col("seq") % 3 > 0, F.when(F.col("seq") % 3 > 1, "").otherwise("443")),
            "tag": F.when(user % 5 > 0, F.col("tag")),
        }
    )


@query
def hot_tag_ordinals(spark, sf_dir):
    """Accepted records where most keys and tags, null ones too, are cut into blocks."""
    found = rank.accepted_records(_keys_with_gaps(spark, sf_dir), block_bits=4)
    return found.select("seq", "scheme", "host", "port", "tag", "tag_no")


@query
def keep_best_survivors(spark, sf_dir):
    """The best record per key by both ways, on keys that mix null and empty parts."""
    events = _keys_with_gaps(spark, sf_dir)
    columns = ["scheme", "host", "port", "tag", "seq", "first_seq"]
    best = rank.keep_best(events).select(F.lit("best").alias("way"), *columns)
    last = rank.survivors(rank.accepted_records(events, block_bits=4))
    return best.unionByName(last.select(F.lit("last").alias("way"), *columns))


@query
def cap_per_source(spark, sf_dir):
    events = I.table(spark, sf_dir, "events").filter(F.col("value") >= 5)
    rows = events.select("event_type", "event_id", "value")
    return cap.cap_per_source(rows, ["event_type"], "event_id", 8)


def _turn_links(spark, sf_dir):
    link = F.concat(
        F.lit("turn://"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"),
        F.lit("#"), F.col("role"),
    )
    seq = F.shiftleft("conv_id", 20) + F.col("turn")
    return I.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", seq.alias("seq"), link.alias("link")
    )


@query
def concat_links(spark, sf_dir):
    return payloads.payload_parts(_turn_links(spark, sf_dir), ["conv_id"], "turn", "link")


PART = 64  # bytes, so that most conversations come in several parts


@query
def concat_links_parts(spark, sf_dir):
    return payloads.payload_parts(_turn_links(spark, sf_dir), ["conv_id"], "turn", "link", PART)


@query
def sink_base64_parts(spark, sf_dir):
    """Payloads of several parts, one of them of a null group, put together again."""
    turns = _turn_links(spark, sf_dir).withColumn("conv_id", F.when(F.col("conv_id") % 10 > 0, F.col("conv_id")))
    parts = payloads.base64_parts(payloads.payload_parts(turns, ["conv_id"], "seq", "link", PART), ["conv_id"], 4)
    whole = F.expr("listagg(text, '') WITHIN GROUP (ORDER BY part)")
    return parts.groupBy("conv_id").agg(whole.alias("text"))


@query
def hot_header_fill(spark, sf_dir):
    """Header fill in blocks, with one feed whose source is null."""
    feed = I.csv_lines(I.table(spark, sf_dir, "customer"))
    rows = csvfeed.fill_headers(feed.withColumn("source", F.nullif("source", F.lit(3))), block_bits=4)
    return rows.select("source", "line_no", F.col("header.at").alias("header_line"))


@query
def uuid_text(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents")
    raw = F.unhex(F.md5(F.col("text").cast("binary")))
    return docs.select("doc_id", ids.uuid_text(raw).alias("uuid"))


@query
def header_fill(spark, sf_dir):
    rows = csvfeed.fill_headers(I.csv_lines(I.table(spark, sf_dir, "customer")))
    return rows.select(
        "source", "line_no", F.col("header.at").alias("header_line"), F.col("header.cells").alias("cells")
    )


@query
def sticky_unit(spark, sf_dir):
    feed = I.csv_lines(I.table(spark, sf_dir, "customer"))
    rows = csvfeed.with_speed(csvfeed.tls_only(csvfeed.fits_header(csvfeed.fill_headers(feed))))
    return rows.filter(F.col("reason").isNull()).select("source", "line_no", "unit", "speed")


def _all_records(spark, sf_dir):
    pages, customer = I.table(spark, sf_dir, "pages"), I.table(spark, sf_dir, "customer")
    return collect_records(
        I.endpoint_lines(pages),
        I.csv_lines(customer).withColumnRenamed("source", "source_ord"),
        I.link_lines(pages),
        csvfeed.CsvOptions.from_setting("5:0"),
    )


@query
def source_union(spark, sf_dir):
    return _all_records(spark, sf_dir)


@query
def setting_roots(spark, sf_dir):
    segment, balance, name = F.col("c_mktsegment"), F.col("c_acctbal"), F.col("c_name")
    rows = I.table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(segment == "BUILDING", F.concat(name, F.lit(" , list "), "c_custkey", F.lit(",,#off"))).alias("req_text"),
        F.when(balance < 0, "").alias("req_csv"),
        F.when(balance > 9000, segment).alias("req_links"),
        F.lit("first\n# note\n\nsecond, third ").alias("stored_text"),
        F.when(balance < 5000, name).alias("stored_csv"),
        F.lit("provider").alias("stored_links"),
    )
    pairs = {k: (f"req_{k}", f"stored_{k}") for k in ("text", "csv", "links")}
    return settings.setting_roots(rows, "c_custkey", pairs, named_lists=("text", "csv"))


@query
def tls_flag(spark, sf_dir):
    balance = F.col("c_acctbal")
    stored = F.when(balance < 0, False).when(balance > 5000, True)
    off = F.when(F.col("c_mktsegment") == "BUILDING", "")
    return I.table(spark, sf_dir, "customer").select("c_custkey", settings.tls_only_flag(stored, off).alias("only_tls"))


@query
def setting_precedence(spark, sf_dir):
    segment, balance = F.col("c_mktsegment"), F.col("c_acctbal")
    rows = I.table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(segment == "BUILDING", F.col("c_name")).alias("req_text"),
        F.when(balance < 0, "").alias("req_csv"),
        F.when(balance > 9000, segment).alias("req_links"),
        F.lit("stored text").alias("stored_text"),
        F.when(balance < 5000, "stored csv").alias("stored_csv"),
        F.lit("stored links").alias("stored_links"),
        F.when(balance > 8000, "7:3").when(balance > 7000, "").alias("req_limit"),
        F.when(balance > 2000, "6").alias("stored_limit"),
    )
    chosen = settings.request_or_stored(
        rows,
        {
            "text_lists": ("req_text", "stored_text"),
            "csv_lists": ("req_csv", "stored_csv"),
            "link_lists": ("req_links", "stored_links"),
        },
    )
    limit = settings.first_setting(F.col("req_limit"), F.col("stored_limit"), default="5")
    return chosen.select("c_custkey", "text_lists", "csv_lists", "link_lists", limit.alias("speed_limit"))


@query
def pool_pick(spark, sf_dir):
    p = I.page_parts(I.table(spark, sf_dir, "pages"))
    entries = F.when(F.col("lang") == "es", F.lit(" #none , ")).otherwise(
        F.concat("host", F.lit(":1, #off.example:2,\n"), F.col("host"), F.lit(":3 "), F.col("lang"), F.lit(".example"))
    )
    return p.select("page_id", pool.pick(pool.pool_entries(entries), F.col("url")).alias("entry"))


# Sinks


@query
def sink_raw(spark, sf_dir):
    """Written as ordered text per role and read back."""
    path = scratch_path(spark, "sink-raw")
    files.write_lines(_turn_links(spark, sf_dir), path, "seq", "link", by=["role"])
    return spark.read.schema("value string, role string").text(path).select(
        "role", F.col("value").alias("link")
    )


@query
def sink_base64(spark, sf_dir):
    parts = payloads.payload_parts(_turn_links(spark, sf_dir), ["conv_id"], "turn", "link")
    return payloads.base64_parts(parts, ["conv_id"])


# The whole feed


@query
def ranked_links(spark, sf_dir):
    feed = ranked_feed(_all_records(spark, sf_dir), user=F.lit("reader"))
    return feed.select("first_seq", "scheme", "host", "port", "tag", "link")


@query
def resolved_feed(spark, sf_dir):
    """Settings name lists, files and providers; their lines become one ranked table."""
    pages, customer = I.table(spark, sf_dir, "pages"), I.table(spark, sf_dir, "customer")
    lists = I.feed_lists(pages, customer)
    text_lines = resolve.text_lines(I.text_setting(pages), lists)
    csv_lines = resolve.csv_lines(I.named_list(spark, "csv files"), lists, I.nation_files(customer))
    link_lines = resolve.link_lines(
        I.named_list(spark, "providers"), lists, I.provider_bodies(pages), (("{user}", "reader"),)
    )
    options = csvfeed.CsvOptions.from_setting("5")
    feed = ranked_feed(collect_records(text_lines, csv_lines, link_lines, options), user=F.lit("reader"))
    return feed.select("scheme", "host", "port", "tag", "link")
