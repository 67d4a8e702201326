"""Queries over text and byte views (documents, pages, conversations) and the short flows of lineitem, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dictionaries, text
from ..operators import line_protocols
from ..sources import views


def payload_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("text").cast("binary")
    return views.table(spark, sf_dir, "documents").select("doc_id", F.length(raw).cast("bigint").alias("pay_len"), F.least(F.length(raw), F.lit(256)).cast("bigint").alias("cap_bytes"), F.lower(F.hex(F.substring(raw, 1, 256))).alias("payload_hex"))


PAYLOAD_HEX = "SELECT doc_id, octet_length(encode(text)) AS pay_len, least(octet_length(encode(text)), 256) AS cap_bytes, lower(substr(hex(encode(text)), 1, 512)) AS payload_hex FROM documents"


def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", F.round(text.byte_entropy(F.col("text").cast("binary")), 6).alias("entropy"))


BYTE_ENTROPY = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), b AS (SELECT doc_id, length(h) / 2 AS n, substr(h, CAST(2 * i - 1 AS BIGINT), 2) AS b FROM (SELECT doc_id, h, unnest(range(1, CAST(length(h) / 2 AS BIGINT) + 1)) AS i FROM h)
), c AS (SELECT doc_id, n, count(*) AS c FROM b GROUP BY doc_id, n, b
), e AS (SELECT doc_id, -sum(c / n * log2(c / n)) AS e FROM c GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(e.e, 0.0), 6) AS entropy FROM documents d LEFT JOIN e ON d.doc_id = e.doc_id"""


def url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", *text.url_parts(F.col("url")))


URL_PARSE = r"""WITH u AS (SELECT page_id, url, regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS r FROM pages
), a AS (SELECT *, regexp_extract(r, '^([^/?#]*)', 1) AS auth, regexp_extract(r, '\?([^#]*)', 1) AS query FROM u)
SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme, regexp_extract(auth, '^([^:]*)', 1) AS host, regexp_extract(auth, ':([0-9]+)$', 1) AS port,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, query, CASE WHEN query = '' THEN 0 ELSE len(string_split(query, '&')) END AS n_params FROM a"""



def http_header_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\nHost: "), F.regexp_replace("url", "^[a-z]+://([^/?#]*).*$", "$1"), F.lit("\r\nUser-Agent: probe/"), (F.col("page_id") % 7).cast("string"), F.lit("\r\nX-Note: Host: no\r\n\r\n"))
    pages = views.table(spark, sf_dir, "pages").withColumn("m", message)
    return pages.select("page_id", text.header(F.col("m"), "Host").alias("host"), text.header(F.col("m"), "user-agent").alias("user_agent"), text.header(F.col("m"), "Cookie").alias("cookie"), F.regexp_extract("m", r"^([A-Z]+) ", 1).alias("method"))


HTTP_HEADER_EXTRACT = "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, concat('probe/', CAST(page_id % 7 AS VARCHAR)) AS user_agent, '' AS cookie, 'GET' AS method FROM pages"


def url_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as they are, and with probes appended by id."""
    url = F.concat("url", F.when(F.col("page_id") % 5 == 0, "?q=1' OR 1=1").when(F.col("page_id") % 5 == 1, "/../../etc/passwd").when(F.col("page_id") % 5 == 2, "?a=UNION+SELECT+1").otherwise(""))
    return views.table(spark, sf_dir, "pages").select("page_id", text.hints(url, text.SQLI_HINTS).alias("sqli_hint"), text.hints(url, text.TRAVERSAL_HINTS).alias("traversal_hint"))


def _contains(x: str, marks: tuple[str, ...]) -> str:
    return " OR ".join("contains({}, '{}')".format(x, m.replace("'", "''")) for m in marks)


URL_HINTS = f"""WITH u AS (SELECT page_id, lower(concat(url, CASE page_id % 5 WHEN 0 THEN '?q=1'' OR 1=1' WHEN 1 THEN '/../../etc/passwd' WHEN 2 THEN '?a=UNION+SELECT+1' ELSE '' END)) AS u FROM pages)
SELECT page_id, ({_contains("u", text.SQLI_HINTS)}) AS sqli_hint, ({_contains("u", text.TRAVERSAL_HINTS)}) AS traversal_hint FROM u"""


def im_sni_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of pages; every ninth is renamed to one of the dictionary, in mixed case."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    pick = F.try_element_at(F.array(*[F.lit(f"WWW.{p.title()}") for p, _, _ in dictionaries.MESSAGING_HOSTS]), (F.col("page_id") % len(dictionaries.MESSAGING_HOSTS) + 1).cast("int"))
    pages = views.table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 9 == 0, pick).otherwise(host).alias("host"))
    name, confidence = dictionaries.messaging_host(F.col("host"))
    return pages.select("page_id", "host", name.alias("app"), confidence.alias("confidence"))


_CASES = " ".join(f"WHEN contains(lower(host), '{p}') THEN '{n}'" for p, n, _ in dictionaries.MESSAGING_HOSTS)
_CONFS = " ".join(f"WHEN contains(lower(host), '{p}') THEN {c}" for p, _, c in dictionaries.MESSAGING_HOSTS)
_NAMES = ", ".join(f"'WWW.{p.title()}'" for p, _, _ in dictionaries.MESSAGING_HOSTS)
IM_SNI_DICTIONARY = f"""WITH h AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN ([{_NAMES}])[CAST(page_id % {len(dictionaries.MESSAGING_HOSTS)} + 1 AS BIGINT)] ELSE regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) END AS host FROM pages)
SELECT page_id, host, CASE {_CASES} END AS app, CASE {_CONFS} ELSE 0 END AS confidence FROM h"""


def ip_range_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Server addresses made from ids, those within the data centres' ranges."""
    n = F.col("page_id")
    ip = F.concat_ws(".", F.when(n % 3 == 0, "91").when(n % 3 == 1, "149").otherwise("95").cast("string"), F.when(n % 3 == 0, "108").when(n % 3 == 1, "154").otherwise("161"), (n * 7 % 256).cast("string"), (n % 256).cast("string"))
    return views.table(spark, sf_dir, "pages").select("page_id", ip.alias("ip")).filter(dictionaries.in_data_centre(F.col("ip"))).select("page_id", "ip", text.ip_number(F.col("ip")).alias("ip_number"))


IP_RANGE_SEMI = """WITH i AS (SELECT page_id, page_id % 3 AS m, page_id * 7 % 256 AS c, page_id % 256 AS d FROM pages)
SELECT page_id, concat_ws('.', CASE m WHEN 0 THEN '91' WHEN 1 THEN '149' ELSE '95' END, CASE m WHEN 0 THEN '108' WHEN 1 THEN '154' ELSE '161' END, CAST(c AS VARCHAR), CAST(d AS VARCHAR)) AS ip,
  CAST((CASE m WHEN 0 THEN 91 WHEN 1 THEN 149 ELSE 95 END) AS BIGINT) * 16777216 + (CASE m WHEN 0 THEN 108 WHEN 1 THEN 154 ELSE 161 END) * 65536 + c * 256 + d AS ip_number
FROM i WHERE m = 0 OR (m = 1 AND c BETWEEN 160 AND 175) OR (m = 2 AND c BETWEEN 76 AND 77)"""


def ja3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of hellos made from ids, reserved values among them."""
    n = F.col("page_id")

    def numbers(*xs) -> Column:
        return F.array(*[x.cast("bigint") if isinstance(x, Column) else F.lit(x).cast("bigint") for x in xs])

    made = views.table(spark, sf_dir, "pages").select("page_id", numbers(2570, 4865 + n % 3, 49195, 0xCACA).alias("c"), numbers(0, 2570, 10 + n % 5, 65281).alias("e"), numbers(0x1A1A, 29, 23).alias("g"), numbers(0).alias("f"))
    line, md5 = text.ja3(F.lit(771), F.col("c"), F.col("e"), F.col("g"), F.col("f"))
    server, server_md5 = text.ja3s(F.lit(771), F.element_at("c", 2), F.col("e"))
    return made.select("page_id", line.alias("ja3"), md5.alias("ja3_md5"), server.alias("ja3s"), server_md5.alias("ja3s_md5"))


JA3_FINGERPRINT = """WITH j AS (SELECT page_id, concat('771,', CAST(4865 + page_id % 3 AS VARCHAR), '-49195,0-', CAST(10 + page_id % 5 AS VARCHAR), '-65281,29-23,0') AS ja3, concat('771,', CAST(4865 + page_id % 3 AS VARCHAR), ',0-', CAST(10 + page_id % 5 AS VARCHAR), '-65281') AS ja3s FROM pages)
SELECT page_id, ja3, md5(ja3) AS ja3_md5, ja3s, md5(ja3s) AS ja3s_md5 FROM j"""


def name_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("turn")
    return views.table(spark, sf_dir, "conversations").select("conv_id", "turn", dictionaries.named(n % 7, dictionaries.DNS_RCODES).alias("rcode"), dictionaries.named(n % 9, dictionaries.DHCP_MESSAGES, F.lit("unknown")).alias("dhcp"), dictionaries.named(n + 20, dictionaries.TLS_RECORDS).alias("record"))


def _map_sql(x: str, names: dict[int, str], other: str) -> str:
    return f"CASE {x} {' '.join(f'WHEN {k} THEN {chr(39)}{v}{chr(39)}' for k, v in names.items())} ELSE {other} END"


NAME_MAPS = f"SELECT conv_id, turn, {_map_sql('turn % 7', dictionaries.DNS_RCODES, 'CAST(turn % 7 AS VARCHAR)')} AS rcode, {_map_sql('turn % 9', dictionaries.DHCP_MESSAGES, chr(39) + 'unknown' + chr(39))} AS dhcp, {_map_sql('turn + 20', dictionaries.TLS_RECORDS, 'CAST(turn + 20 AS VARCHAR)')} AS record FROM conversations"

# ---- line protocols over conversations: the user's turns are the client's lines, all others the server's ----


def _lines(spark: SparkSession, sf_dir: str, commands: tuple[str, ...], replies: tuple[str, ...]) -> DataFrame:
    """Turns as protocol lines: a command or reply chosen by the turn, then the beginning of the text."""
    client = F.col("role") == "user"
    word = F.when(client, F.try_element_at(F.array(*map(F.lit, commands)), (F.col("turn") % len(commands) + 1).cast("int"))).otherwise(F.try_element_at(F.array(*map(F.lit, replies)), (F.col("turn") % len(replies) + 1).cast("int")))
    return views.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("flow"), F.col("turn").alias("pkt_no"), client.alias("client"), word.alias("line"))


SMTP_COMMANDS = ("EHLO probe.example.com", "MAIL FROM:<a@example.com>", "RCPT TO:<b@example.org>", "DATA", "QUIT", "AUTH LOGIN")
SMTP_REPLIES = ("220 ready", "250 ok", "354 go on", "550 no", "235 welcome", "421 later")
FTP_COMMANDS = ("USER guest", "PASS secret", "PASV", "RETR a.bin", "STOR b.bin", "LIST")
FTP_REPLIES = ("220 ready", "331 password", "230 logged in", "227 Entering Passive Mode (192,0,2,9,19,137)", "550 no", "226 done")


def smtp_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_protocols.smtp(_lines(spark, sf_dir, SMTP_COMMANDS, SMTP_REPLIES))


def ftp_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_protocols.ftp(_lines(spark, sf_dir, FTP_COMMANDS, FTP_REPLIES))


def _lines_sql(commands: tuple[str, ...], replies: tuple[str, ...]) -> str:
    def listed(xs: tuple[str, ...]) -> str:
        return "[" + ", ".join(f"'{x}'" for x in xs) + "]"

    return f"WITH l AS (SELECT conv_id AS flow, turn AS pkt_no, role = 'user' AS client, CASE WHEN role = 'user' THEN ({listed(commands)})[CAST(turn % {len(commands)} + 1 AS BIGINT)] ELSE ({listed(replies)})[CAST(turn % {len(replies)} + 1 AS BIGINT)] END AS line FROM conversations)\n"


SMTP_FOLD = (
    _lines_sql(SMTP_COMMANDS, SMTP_REPLIES)
    + """SELECT flow, max(substr(line, 6)) FILTER (client AND starts_with(line, 'EHLO')) AS helo, max(regexp_extract(line, '<([^>]*)>', 1)) FILTER (client AND starts_with(line, 'MAIL FROM')) AS mail_from,
  count(*) FILTER (client AND starts_with(line, 'RCPT TO')) AS rcpt_count, count(*) FILTER (client AND line = 'DATA') AS data_count, coalesce(bool_or(client AND starts_with(line, 'AUTH')), FALSE) AS auth_seen, FALSE AS starttls, coalesce(bool_or(client AND line = 'QUIT'), FALSE) AS quit_seen,
  coalesce(bool_or(NOT client AND substr(line, 1, 3) IN ('235', '250')), FALSE) AS login_ok, count(*) FILTER (NOT client AND starts_with(line, '2')) AS resp_2xx, count(*) FILTER (NOT client AND starts_with(line, '3')) AS resp_3xx,
  count(*) FILTER (NOT client AND starts_with(line, '4')) AS resp_4xx, count(*) FILTER (NOT client AND starts_with(line, '5')) AS resp_5xx, count(*) AS events FROM l GROUP BY flow"""
)
FTP_FOLD = (
    _lines_sql(FTP_COMMANDS, FTP_REPLIES)
    + """SELECT flow, max(substr(line, 6)) FILTER (client AND starts_with(line, 'USER')) AS username, coalesce(bool_or(client AND starts_with(line, 'PASS')), FALSE) AS pass_seen, coalesce(bool_or(NOT client AND starts_with(line, '230')), FALSE) AS login_ok,
  count(*) FILTER (client AND (starts_with(line, 'PASV') OR starts_with(line, 'EPSV'))) AS passive, 0 AS active, count(*) FILTER (client AND starts_with(line, 'RETR')) AS retr_count, count(*) FILTER (client AND starts_with(line, 'STOR')) AS stor_count, count(*) FILTER (client AND starts_with(line, 'LIST')) AS list_count,
  max(CASE WHEN starts_with(line, '227') THEN '192.0.2.9' END) FILTER (NOT client) AS pasv_host, max(CASE WHEN starts_with(line, '227') THEN 19 * 256 + 137 END) FILTER (NOT client) AS pasv_port, count(*) AS events FROM l GROUP BY flow"""
)

# ---- short flows ----


def lineitem_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.packets_from_lineitem(views.table(spark, sf_dir, "lineitem"))
    gap = F.col("ts_us") - F.lag("ts_us").over(Window.partitionBy("flow_no").orderBy("idx"))
    df = df.withColumn("gap", gap)
    x = F.col("wirelen")
    n = F.count(F.lit(1))
    mean = F.sum(x) / n
    return df.groupBy("flow_no").agg(
        n.alias("packets"), F.sum("wirelen").alias("bytes"), F.count_if(F.col("true_dir") == 1).alias("up_packets"), F.round(mean, 6).alias("len_mean"), F.round(F.sqrt(F.greatest(F.sum(x * x) / n - mean * mean, F.lit(0.0))), 6).alias("len_std"),
        F.min("gap").alias("min_gap_us"), F.max("gap").alias("max_gap_us"), F.countDistinct("server_no").alias("servers"),
    )


LINEITEM_FLOWS = (
    "WITH "
    + views.LINEITEM_SQL
    + """, g AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY flow_no ORDER BY idx) AS gap FROM li)
SELECT flow_no, count(*) AS packets, CAST(sum(wirelen) AS BIGINT) AS bytes, count(*) FILTER (true_dir = 1) AS up_packets, round(CAST(sum(wirelen) AS DOUBLE) / count(*), 6) AS len_mean,
  round(sqrt(greatest(CAST(sum(wirelen * wirelen) AS DOUBLE) / count(*) - (CAST(sum(wirelen) AS DOUBLE) / count(*)) * (CAST(sum(wirelen) AS DOUBLE) / count(*)), 0.0)), 6) AS len_std,
  min(gap) AS min_gap_us, max(gap) AS max_gap_us, count(DISTINCT server_no) AS servers FROM g GROUP BY flow_no"""
)


def lineitem_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.packets_from_lineitem(views.table(spark, sf_dir, "lineitem"))
    order = Window.partitionBy("flow_no").orderBy("idx")
    df = df.withColumn("change", F.when(F.lag("true_dir").over(order) == F.col("true_dir"), 0).otherwise(1)).withColumn("run", F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = df.groupBy("flow_no", "run").agg(F.sum("true_dir").alias("n"), F.sum("wirelen").alias("bytes"))
    return runs.groupBy("flow_no").agg(F.count(F.lit(1)).alias("n_bursts"), F.max(F.abs("n")).alias("longest"), F.max("bytes").alias("most_bytes"))


LINEITEM_BURSTS = (
    "WITH "
    + views.LINEITEM_SQL
    + """, c AS (SELECT *, CASE WHEN lag(true_dir) OVER (PARTITION BY flow_no ORDER BY idx) = true_dir THEN 0 ELSE 1 END AS change FROM li
), r AS (SELECT *, sum(change) OVER (PARTITION BY flow_no ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM c), s AS (SELECT flow_no, run, sum(true_dir) AS n, sum(wirelen) AS bytes FROM r GROUP BY flow_no, run)
SELECT flow_no, count(*) AS n_bursts, CAST(max(abs(n)) AS BIGINT) AS longest, CAST(max(bytes) AS BIGINT) AS most_bytes FROM s GROUP BY flow_no"""
)

QUERIES = {
    "payload_hex": payload_hex, "byte_entropy": byte_entropy, "url_parse": url_parse, "http_header_extract": http_header_extract, "url_hints": url_hints, "im_sni_dictionary": im_sni_dictionary, "ip_range_semi": ip_range_semi, "ja3_fingerprint": ja3_fingerprint,
    "name_maps": name_maps, "smtp_fold": smtp_fold, "ftp_fold": ftp_fold, "lineitem_flows": lineitem_flows, "lineitem_bursts": lineitem_bursts,
}
ORACLES = {
    "payload_hex": PAYLOAD_HEX, "byte_entropy": BYTE_ENTROPY, "url_parse": URL_PARSE, "http_header_extract": HTTP_HEADER_EXTRACT, "url_hints": URL_HINTS, "im_sni_dictionary": IM_SNI_DICTIONARY, "ip_range_semi": IP_RANGE_SEMI, "ja3_fingerprint": JA3_FINGERPRINT,
    "name_maps": NAME_MAPS, "smtp_fold": SMTP_FOLD, "ftp_fold": FTP_FOLD, "lineitem_flows": LINEITEM_FLOWS, "lineitem_bursts": LINEITEM_BURSTS,
}
