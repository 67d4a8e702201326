"""SMTP and FTP by flow, from protocol lines: flow, pkt_no (order), client (whether the client sent it), line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines_of(packets: DataFrame, payload: str = "payload", client: str = "client_to_server") -> DataFrame:
    """Lines of each direction's payloads in order: bytes are joined across packets before they are cut at line ends."""
    text = packets.groupBy("flow", F.col(client).alias("client")).agg(F.array_sort(F.collect_list(F.struct("pkt_no", F.decode(F.col(payload), "ISO-8859-1").alias("t")))).alias("r"))
    joined = text.select("flow", "client", F.element_at("r", 1)["pkt_no"].alias("first"), F.array_join(F.transform("r", lambda x: x["t"]), "").alias("t"))
    cut = joined.select("flow", "client", "first", F.posexplode(F.split(F.regexp_replace("t", "\r?\n$", ""), "\r?\n")).alias("n", "line"))
    return cut.select("flow", (F.col("first") * 1_000_000 + F.col("n")).alias("pkt_no"), "client", "line").filter("line <> ''")


def _first(value: Column, cond: Column) -> Column:
    return F.min_by(F.when(cond, value), F.when(cond, F.col("pkt_no")))


def _code(line: Column) -> Column:
    return F.substring(line, 1, 3)


def smtp(lines: DataFrame) -> DataFrame:
    """One row for each flow; a reply of 235 or 250 counts as a login."""
    line, mine = F.col("line"), F.col("client")
    up = F.upper(line)
    hello, mail, rcpt = mine & up.rlike("^(EHLO|HELO)"), mine & up.startswith("MAIL FROM"), mine & up.startswith("RCPT TO")
    return lines.groupBy("flow").agg(
        _first(F.substring(line, 6, 255), hello).alias("helo"), _first(F.regexp_extract(line, "<([^>]*)>", 1), mail).alias("mail_from"), F.count_if(rcpt).alias("rcpt_count"), F.count_if(mine & (up == "DATA")).alias("data_count"),
        F.coalesce(F.max(mine & up.startswith("AUTH")), F.lit(False)).alias("auth_seen"), F.coalesce(F.max(mine & up.startswith("STARTTLS")), F.lit(False)).alias("starttls"), F.coalesce(F.max(mine & up.startswith("QUIT")), F.lit(False)).alias("quit_seen"),
        F.coalesce(F.max(~mine & _code(line).isin("235", "250")), F.lit(False)).alias("login_ok"), *[F.count_if(~mine & line.startswith(str(k))).alias(f"resp_{k}xx") for k in (2, 3, 4, 5)], F.count(F.lit(1)).alias("events"),
    )


def ftp(lines: DataFrame) -> DataFrame:
    """One row for each flow; passwords are noticed, not kept."""
    line, mine = F.col("line"), F.col("client")
    up = F.upper(line)
    passive = ~mine & line.startswith("227")
    numbers = F.regexp_extract_all(line, F.lit(r"(\d+)"), F.lit(1))

    def count(pattern: str) -> Column:
        return F.count_if(mine & up.rlike(pattern))

    return lines.groupBy("flow").agg(
        _first(F.substring(line, 6, 255), mine & up.startswith("USER")).alias("username"), F.coalesce(F.max(mine & up.startswith("PASS ")), F.lit(False)).alias("pass_seen"), F.coalesce(F.max(~mine & line.startswith("230")), F.lit(False)).alias("login_ok"),
        count("^(PASV|EPSV)").alias("passive"), count("^(PORT|EPRT)").alias("active"), count("^RETR").alias("retr_count"), count("^(STOR|STOU|APPE)").alias("stor_count"), count("^(LIST|NLST|MLSD)").alias("list_count"),
        _first(F.concat_ws(".", F.slice(numbers, 2, 4)), passive).alias("pasv_host"), _first(F.try_element_at(numbers, F.lit(6)).cast("int") * 256 + F.try_element_at(numbers, F.lit(7)).cast("int"), passive).alias("pasv_port"), F.count(F.lit(1)).alias("events"),
    )
