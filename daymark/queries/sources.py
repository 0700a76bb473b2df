"""Queries on the log formats: raw rows written from the tables in each format, read back as canonical events."""

from __future__ import annotations

from pyspark.sql import functions as F

from daymark.functions import security as se
from daymark.functions import timeparts as tp
from daymark.operators import profile as pf
from daymark.operators import sampling as sm
from daymark.operators.results import CELL
from daymark.queries.common import labelled_events, result_table, rounded, stage, user_days
from daymark.queries.registry import cte, draw_sql, query, sql
from daymark.session import work_path
from daymark.sources import cache, cert, lanl, optc, resultlog, spedia
from daymark.sources import tables as tb

_EVENT = ["event_id", "timestamp", "user", "src_host", "dst_host", "action", "object"]


def _case(column: str, values: dict[str, str], other=None):
    out = None
    for k, v in values.items():
        cond = F.col(column) == k
        value = F.lit(v) if isinstance(v, str) else v
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out if other is None else out.otherwise(other)


# ---- company activity logs ------------------------------------------------------------------------


def _cert_raw(raw):
    bad = (F.col("action") == "auth") & (F.col("value") > 20)
    date = F.when(bad, "n/a").otherwise(F.date_format("timestamp", cert.DATE_FORMAT))
    return raw.select(F.col("event_id").alias("id"), date.alias("date"), "user", F.col("src_host").alias("pc"),
                      "action", "object")


_CERT_SQL = """SELECT event_id, date_trunc('second', "timestamp") AS "timestamp", "user", src_host, src_host AS dst_host,
    {action} AS action, {object} AS object FROM raw WHERE NOT (action = 'auth' AND value > 20)"""
_LONG = "substr(repeat(object, 20), 1, 120)"


@query(
    "cert_session_projection",
    sql(_CERT_SQL.format(object="'unknown'", action="""CASE action WHEN 'http' THEN 'logon' WHEN 'file_delete' THEN 'logon'
        WHEN 'file_read' THEN 'logoff' WHEN 'file_write' THEN 'usb_connect' WHEN 'logon' THEN 'usb_disconnect' ELSE 'unknown' END"""),
        "raw"),
)
def cert_session_projection(spark, sf_dir):
    words = {"http": "Logon", "file_delete": "Logon", "file_read": "Logoff", "file_write": "Connect",
             "logon": "Disconnect", "auth": "Reboot", "email_send": "logon"}
    rows = _cert_raw(tb.raw_events(spark, sf_dir)).withColumn("activity", _case("action", words))
    return cert.project(rows.drop("action", "object"), "logon", "cert").select(*_EVENT)


@query(
    "cert_file_projection",
    sql(_CERT_SQL.format(object=_LONG, action="""CASE action WHEN 'http' THEN 'file_read' WHEN 'file_read' THEN 'file_write'
        WHEN 'file_write' THEN 'file_write' WHEN 'logon' THEN 'file_delete' ELSE 'file_write' END"""), "raw"),
)
def cert_file_projection(spark, sf_dir):
    words = {"http": "File Open", "file_read": "File Copy", "file_write": "File Write", "logon": "File Delete"}
    rows = _cert_raw(tb.raw_events(spark, sf_dir)).withColumn("activity", _case("action", words, F.lit("Scan")))
    rows = rows.withColumn("filename", F.repeat("object", 20)).drop("action", "object")
    return cert.project(rows, "file", "cert").select(*_EVENT)


@query("cert_email_projection", sql(_CERT_SQL.format(object=_LONG, action="'email_send'"), "raw"))
def cert_email_projection(spark, sf_dir):
    """The older layout without an activity column."""
    rows = _cert_raw(tb.raw_events(spark, sf_dir)).withColumn("to", F.repeat("object", 20)).drop("action", "object")
    return cert.project(rows, "email", "cert").select(*_EVENT)


@query(
    "cert_releases_from_files",
    sql(
        f"""SELECT release AS dataset, "user", CAST("timestamp" AS DATE) AS day, action, max(label) AS label, count(*) AS n FROM (
          SELECT CASE WHEN dataset = 'retail' THEN 'b' ELSE 'a' END AS release, "user", "timestamp", event_id,
            CASE action WHEN 'logon' THEN 'logon' WHEN 'http' THEN 'http' ELSE 'file_write' END AS action,
            CASE WHEN (dataset, "user", day) IN (SELECT (dataset, "user", day) FROM keys) THEN 1 ELSE 0 END AS label FROM raw)
        WHERE action <> 'http' OR {draw_sql("'7'", 'event_id')} < 0.05 GROUP BY ALL""",
        "raw", "keys",
    ),
)
def cert_releases_from_files(spark, sf_dir):
    """Two releases written as CSV channels with answer files, loaded back with the label-blind web sample."""
    root = work_path(spark, "cert")
    raw = tb.raw_events(spark, sf_dir)
    date = F.date_format("timestamp", cert.DATE_FORMAT).alias("date")
    common = [F.col("event_id").alias("id"), date, "user", F.col("src_host").alias("pc")]
    releases = {"a": F.col("dataset") != "retail", "b": F.col("dataset") == "retail"}
    for name, where in releases.items():
        part = raw.filter(where)
        out = f"{root}/{name}"
        part.filter("action = 'logon'").select(*common, F.lit("Logon").alias("activity")).write.option("header", True).csv(f"{out}/logon.csv")
        part.filter("action = 'http'").select(*common, F.col("object").alias("url")).write.option("header", True).csv(f"{out}/http.csv")
        part.filter("action NOT IN ('logon', 'http')").select(*common, F.col("object").alias("filename")).write.option("header", True).csv(f"{out}/file.csv")
        hits = part.filter("is_positive")
        hits.select(F.lit("x").alias("kind"), "event_id", date, "user", "src_host").write.csv(f"{root}/answers/r{name}-1")
        people = hits.select(F.lit(name).alias("dataset"), F.lit("1").alias("scenario"), F.lit("").alias("details"), "user").distinct()
        people.write.mode("append").option("header", True).csv(f"{root}/answers/insiders.csv")
        for i, f in enumerate(cert.glob_paths(spark, f"{root}/answers/r{name}-1/part-*")):
            _rename(spark, f, f"{root}/answers/r{name}-1/r{name}-1-{i}.csv")
    loaded = cert.load_releases(
        spark, {n: (f"{root}/{n}", n) for n in releases}, answers=f"{root}/answers", sources=("logon", "file"), http="uniform"
    )
    return loaded.groupBy("dataset", "user", "day", "action").agg(F.max("label").alias("label"), F.count(F.lit(1)).alias("n"))


def _rename(spark, old: str, new: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    path(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(path(old), path(new))


# ---- authentication log ---------------------------------------------------------------------------


def _lanl_raw(raw):
    machine = (F.col("action") == "http") & F.col("src_host").isin("h1", "h2")
    computer = (F.col("action") == "logon") & (F.col("src_host") == "h3")
    user = F.when(machine, F.concat("user", F.lit("$"))).when(computer, F.concat(F.lit("C"), F.expr("substr(user, 2)")))
    seconds = F.floor(tp.micros(F.col("timestamp")) / 1_000_000) - 1420070400
    bad = (F.col("action") == "auth") & (F.col("value") > 40)
    return raw.select(
        F.when(bad, "?").otherwise(seconds.cast("string")).alias("time"),
        F.concat(F.coalesce(user, F.col("user")), F.lit("@DOM1")).alias("src_user"),
        F.concat("user", F.lit("@DOM1")).alias("dst_user"),
        F.col("src_host").alias("src_comp"), F.col("dst_host").alias("dst_comp"),
        F.lit("NTLM").alias("auth_type"), F.col("object").alias("logon_type"),
        _case("action", {"file_read": "LogOn", "file_write": "LogOff"}, F.lit("TGS")).alias("auth_orientation"),
        F.lit("Success").alias("success"),
    )


cte(
    "auth_rows",
    """
    SELECT date_trunc('second', "timestamp") AS "timestamp", "user", src_host, dst_host,
      CASE action WHEN 'file_read' THEN 'logon' WHEN 'file_write' THEN 'logoff' ELSE 'auth' END AS action,
      substr('NTLM:' || object || ':Success', 1, 120) AS object FROM raw
    WHERE NOT (action = 'http' AND src_host IN ('h1', 'h2')) AND NOT (action = 'logon' AND src_host = 'h3')
      AND NOT (action = 'auth' AND value > 40)
    """,
    "raw",
)


@query("auth_projection", sql("SELECT * FROM auth_rows", "auth_rows"))
def auth_projection(spark, sf_dir):
    out = lanl.project(_lanl_raw(tb.raw_events(spark, sf_dir)))
    return out.select("timestamp", "user", "src_host", "dst_host", "action", "object")


@query(
    "auth_from_files",
    sql(
        """SELECT "user", CAST("timestamp" AS DATE) AS day, action, count(*) AS n, max(CASE WHEN ("user", CAST("timestamp" AS DATE))
        IN (SELECT ("user", day) FROM keys) THEN 1 ELSE 0 END) AS label FROM auth_rows GROUP BY ALL""",
        "auth_rows", "keys",
    ),
)
def auth_from_files(spark, sf_dir):
    """The headerless log written as gzip files and the record list as plain text, loaded back."""
    path = work_path(spark, "auth")
    raw = tb.raw_events(spark, sf_dir)
    _lanl_raw(raw).write.option("compression", "gzip").option("quote", "").csv(f"{path}/auth.txt.gz")
    _lanl_raw(raw.filter("is_positive").withColumn("action", F.lit("x"))).select(
        "time", "dst_user", "src_comp", "dst_comp"
    ).write.csv(f"{path}/redteam.txt")
    out = lanl.load(spark, path, mode="all")
    return out.groupBy("user", "day", "action").agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("label"))


# ---- host telemetry -------------------------------------------------------------------------------


def _telemetry_lines(raw):
    """Events as JSON lines with mixed time formats, principals and properties; some lines are broken."""
    v = F.floor("value").cast("long")
    iso = F.concat(F.date_format(F.col("timestamp") - F.expr("INTERVAL '4' HOUR"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("-04:00"))
    millis = F.floor(tp.micros(F.col("timestamp")) / 1000).cast("string")
    time = F.when((v % 2 == 1) & (F.col("dataset") != "retail"), millis).otherwise(iso)
    principal = (
        F.when(v % 4 == 0, F.concat(F.lit("CORP\\"), "user"))
        .when(v % 4 == 1, F.concat("user", F.lit("@corp")))
        .when(v % 4 == 2, F.lit("NT AUTHORITY\\SYSTEM"))
        .otherwise(F.lit(""))
    )
    names = {"http": "flow", "file_read": "FILE", "file_write": "File", "file_delete": "FILE", "logon": "USER_SESSION",
             "auth": "PROCESS", "email_send": "SHELL"}
    acts = {"http": "start", "file_read": "READ", "file_write": "MODIFY", "file_delete": "DELETE", "logon": "LOGIN",
            "auth": "TERMINATE", "email_send": "COMMAND"}
    way = F.when(v % 3 == 0, "outbound").when(v % 3 == 1, "inbound").otherwise("")
    port = F.element_at(F.array(F.lit("22"), F.lit("21"), F.lit("443"), F.lit("9999")), (v % 4 + 1).cast("int"))
    flow = F.create_map(F.lit("direction"), way, F.lit("src_ip"), F.col("src_host"), F.lit("dest_ip"),
                        F.when(v % 5 == 0, "").otherwise(F.col("dst_host")), F.lit("dest_port"), port)
    one = lambda k, c: F.create_map(F.lit(k), c)
    props = (
        F.when(F.col("action") == "http", flow)
        .when(F.col("action") == "file_read", one("file_path", F.col("object")))
        .when(F.col("action") == "file_write", F.create_map(F.lit("file_path"), F.lit(" "), F.lit("new_path"), F.col("object")))
        .when(F.col("action") == "logon", one("requesting_user", F.col("user")))
        .when(F.col("action") == "auth", one("image_path", F.col("object")))
        .when(F.col("action") == "email_send", one("payload", F.repeat("object", 30)))
    )
    line = F.to_json(F.struct(
        time.alias("timestamp"), F.col("event_id").alias("id"), F.concat("src_host", F.lit(".corp.local")).alias("hostname"),
        _case("action", names).alias("object"), _case("action", acts).alias("action"), principal.alias("principal"),
        props.alias("properties"),
    ))
    broken = (F.col("action") == "auth") & (v % 7 == 0)
    return stage(raw.select(F.when(broken, F.substring(line, 1, 40)).otherwise(line).alias("value")), "lines")


cte(
    "telemetry",
    """
    SELECT *, CASE WHEN action IN ('logon') OR v % 4 IN (0, 1) THEN 'direct' WHEN d.host IS NOT NULL THEN 'dom' ELSE 'pseudo' END
        AS attribution,
      CASE WHEN action IN ('logon') OR v % 4 IN (0, 1) THEN "user" ELSE coalesce(d.dominant_user, 'host:' || src_host) END AS who,
      CASE action WHEN 'http' THEN CASE v % 4 WHEN 0 THEN 'ssh' WHEN 1 THEN 'ftp' ELSE 'http' END WHEN 'auth' THEN 'unknown'
        WHEN 'email_send' THEN 'cmd_exec' ELSE action END AS act,
      CASE action WHEN 'http' THEN CASE WHEN v % 3 = 1 OR v % 5 = 0 THEN src_host ELSE dst_host END
        ELSE src_host || '.corp.local' END AS target,
      substr(CASE action WHEN 'http' THEN CASE WHEN v % 5 = 0 THEN src_host ELSE dst_host END WHEN 'file_delete' THEN 'unknown'
        WHEN 'logon' THEN "user" WHEN 'email_send' THEN repeat(object, 30) ELSE object END, 1, 120) AS obj,
      CASE WHEN v % 2 = 1 AND dataset <> 'retail' THEN date_trunc('millisecond', "timestamp") ELSE "timestamp" END AS t
    FROM (SELECT *, CAST(floor(value) AS BIGINT) AS v FROM in_span) r LEFT JOIN dominant d ON d.host = r.src_host AND d.day = r.day
    WHERE NOT (action = 'auth' AND v % 7 = 0)
    """,
    "in_span", "dominant",
)


@query(
    "telemetry_events",
    sql(
        """SELECT event_id, t AS "timestamp", who AS "user", src_host || '.corp.local' AS src_host, target AS dst_host, act AS action,
        obj AS object, CASE WHEN in_interval THEN 1 ELSE 0 END AS label,
        CASE WHEN in_interval THEN 'apt_redteam' ELSE 'benign' END AS insider_type, attribution FROM telemetry""",
        "telemetry",
    ),
)
def telemetry_events(spark, sf_dir):
    raw = tb.raw_events(spark, sf_dir)
    out = optc.events_from_lines(_telemetry_lines(raw), tb.intervals(raw), fraction=None)
    return out.select(*_EVENT, "label", "insider_type", "attribution")


@query(
    "telemetry_from_files",
    sql(
        f"""SELECT attribution, act AS action, count(*) AS n, CAST(sum(CASE WHEN in_interval THEN 1 ELSE 0 END) AS BIGINT) AS n_pos
        FROM telemetry WHERE in_interval OR {draw_sql("'7'", 'event_id')} < 0.02 GROUP BY ALL""",
        "telemetry",
    ),
)
def telemetry_from_files(spark, sf_dir):
    """The lines written as gzip shards, with folders that must be skipped, sampled outside the intervals."""
    path = work_path(spark, "ecar")
    raw = tb.raw_events(spark, sf_dir)
    lines = _telemetry_lines(raw)
    lines.write.option("compression", "gzip").text(f"{path}/parts")
    skipped = lines.limit(20)
    for i, f in enumerate(cert.glob_paths(spark, f"{path}/parts/part-*")):
        folder = "evaluation" if i % 2 else "benign"
        _mkdirs(spark, f"{path}/ecar/{folder}/d{i}")
        _rename(spark, f, f"{path}/ecar/{folder}/d{i}/shard{i}.json.gz")
    skipped.write.text(f"{path}/other")
    for i, f in enumerate(cert.glob_paths(spark, f"{path}/other/part-*")):
        _mkdirs(spark, f"{path}/ecar/benign/short")
        _rename(spark, f, f"{path}/ecar/benign/short/s{i}.json")
    tb.intervals(raw).select(
        F.col("host").alias("hostname"), F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("end_time"),
        F.date_format("end", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("start_time"),
    ).write.option("header", True).csv(f"{path}/redteam_intervals.csv")
    events = optc.events_from_lines(optc.read_lines(spark, path), optc.read_intervals(spark, path))
    return events.groupBy("attribution", "action").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_pos"))


def _mkdirs(spark, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


@query(
    "telemetry_profile",
    sql(
        """SELECT src_host AS host, count(*) AS n, count(*) FILTER (cls = 'empty') AS n_empty, count(*) FILTER (cls = 'service')
        AS n_service, count(*) FILTER (cls = 'real') AS n_real, count(DISTINCT "user" || '@' || day) FILTER (cls = 'real' AND
        hit) AS n_positive_user_days, count(*) FILTER (action = 'http') AS n_remote,
        round(count(*) FILTER (cls = 'real') / count(*), 8) AS real_rate,
        CASE WHEN count(*) FILTER (cls = 'real') >= 0.5 * count(*) AND count(*) FILTER (cls = 'real' AND hit) > 0
          THEN 'GO' ELSE 'NO-GO' END AS verdict
        FROM (SELECT *, CASE WHEN v % 4 IN (0, 1) OR (v % 4 = 3 AND action = 'logon') THEN 'real' WHEN v % 4 = 2 THEN 'service'
          ELSE 'empty' END AS cls, event_id IN (SELECT event_id FROM raw WHERE is_positive) AS hit FROM telemetry) GROUP BY 1""",
        "telemetry",
    ),
)
def telemetry_profile(spark, sf_dir):
    raw = tb.raw_events(spark, sf_dir)
    ids = raw.filter("is_positive").select("event_id")
    out = pf.telemetry_profile(optc.parse(_telemetry_lines(raw)), ids)
    return rounded(out, ["real_rate"], 8)


@query(
    "telemetry_property_keys",
    sql("SELECT object, key, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE action WHEN 'http' THEN 'FLOW' WHEN 'logon' THEN 'USER_SESSION' "
        "WHEN 'auth' THEN 'PROCESS' WHEN 'email_send' THEN 'SHELL' ELSE 'FILE' END AS object, unnest(CASE action WHEN 'http' THEN "
        "['direction', 'src_ip', 'dest_ip', 'dest_port'] WHEN 'file_read' THEN ['file_path'] WHEN 'file_write' THEN ['file_path', "
        "'new_path'] WHEN 'logon' THEN ['requesting_user'] WHEN 'auth' THEN ['image_path'] WHEN 'email_send' THEN ['payload'] "
        "ELSE [] END) AS key, 1 AS n FROM telemetry) GROUP BY ALL", "telemetry"),
)
def telemetry_property_keys(spark, sf_dir):
    return pf.property_keys(optc.parse(_telemetry_lines(tb.raw_events(spark, sf_dir))))


# ---- exercise log ---------------------------------------------------------------------------------


def _exercise_rows(raw):
    v = F.floor("value").cast("long")
    desc = F.element_at(F.array(F.lit("Highly Suspicious cmd"), F.lit("a midly suspicious one"), F.lit("Lowly Suspicious"),
                                F.lit("Non Suspicious"), F.lit(None)), (v % 5 + 1).cast("int"))
    files = F.col("action").isin("file_read", "file_write", "file_delete")
    return raw.select(
        "event_id", F.col("src_host").alias("Agent_name"), F.when(v % 11 != 0, F.col("user")).alias("User"),
        F.when(v % 13 == 0, "soon").otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).alias("Timestamp"),
        F.when(v % 3 == 0, "cert").when(v % 3 == 1, "pam").alias("Decoder_name"), desc.alias("Description"),
        F.when(v % 17 == 0, "high").otherwise((v % 12).cast("string")).alias("Level"),
        _case("action", {"http": "HTTP", "logon": "session", "auth": "Session", "email_send": "email"},
              F.when(files, "File")).alias("Activity"),
        _case("action", {"file_read": "opened", "file_write": "File Modified", "logon": "Logon", "auth": "Failed logon",
                         "file_delete": "Deleted"}).alias("Action"),
        F.lit(None).cast("string").alias("Command"), F.when(F.col("action") == "http", F.col("object")).alias("Url"),
        F.when(files, F.col("object")).alias("Filename"), F.when(F.col("action") == "logon", F.lit("/bin/login")).alias("Path"),
    )


_EXERCISE_SQL = """SELECT event_id, date_trunc('second', "timestamp") AS "timestamp", CASE WHEN v % 11 = 0 THEN 'unknown' ELSE "user" END
    AS "user", src_host, action, CASE WHEN action IN ('http', 'file_read', 'file_write', 'file_delete') THEN object
    WHEN action = 'logon' THEN '/bin/login' ELSE 'unknown' END AS object,
    CASE WHEN v % 5 IN (0, 1) OR (v % 17 <> 0 AND v % 12 >= 8) THEN 1 ELSE 0 END AS label
    FROM (SELECT *, CAST(floor(value) AS BIGINT) AS v FROM raw) WHERE v % 13 <> 0"""


@query("exercise_events", sql(_EXERCISE_SQL, "raw"))
def exercise_events(spark, sf_dir):
    return spedia.project(_exercise_rows(tb.raw_events(spark, sf_dir))).select(
        "event_id", "timestamp", "user", "src_host", "action", "object", "label"
    )


@query(
    "exercise_real_rows",
    sql("SELECT action, label, count(*) AS n FROM (" + _EXERCISE_SQL + " AND v % 3 <> 0) GROUP BY ALL", "raw"),
)
def exercise_real_rows(spark, sf_dir):
    """Written as one CSV, read back without the rows derived from another data set."""
    path = work_path(spark, "exercise")
    _exercise_rows(tb.raw_events(spark, sf_dir)).write.option("header", True).csv(path)
    out = spedia.load(spark, path, real_only=True)
    return out.groupBy("action", "label").agg(F.count(F.lit(1)).alias("n"))


# ---- scalar rules on whole columns ----------------------------------------------------------------


@query(
    "account_names",
    """SELECT c_custkey, CASE WHEN k IN (2, 3) THEN CASE WHEN k = 2 THEN '' ELSE 'SYSTEM' END WHEN k = 4 THEN n || '$' WHEN k = 5 THEN
      'local service' WHEN k = 6 THEN 'C' || c_custkey ELSE n END AS bare, k IN (2, 3, 4, 5) AS is_service, k IN (4, 6) AS is_machine,
      CASE WHEN k = 2 THEN '' ELSE 'H' || c_nationkey END AS host
    FROM (SELECT *, c_custkey % 7 AS k, 'User' || c_custkey AS n FROM customer)""",
)
def account_names(spark, sf_dir):
    """Account and host texts in every known shape."""
    c = tb.table(spark, sf_dir, "customer")
    k, n = F.col("c_custkey") % 7, F.concat(F.lit("User"), "c_custkey")
    raw = (
        F.when(k == 0, F.concat(F.lit("CORP\\"), n)).when(k == 1, F.concat(n, F.lit("@corp.local"))).when(k == 2, " NaN ")
        .when(k == 3, "NT AUTHORITY\\SYSTEM").when(k == 4, F.concat(n, F.lit("$"))).when(k == 5, "local service")
        .otherwise(F.concat(F.lit("C"), "c_custkey"))
    )
    host = F.when(k == 2, "None").otherwise(F.concat(F.lit("H"), "c_nationkey", F.lit(".corp.local")))
    rows = c.select("c_custkey", raw.alias("raw"), host.alias("host"))
    bare = se.bare_user(F.col("raw"))
    return rows.select("c_custkey", bare.alias("bare"), se.is_service_account(F.col("raw")).alias("is_service"),
                       se.is_machine_account(bare).alias("is_machine"), se.norm_host(F.col("host")).alias("host"))


@query(
    "mixed_timestamps",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('millisecond', ts) WHEN 1 THEN date_trunc('second', ts)
      WHEN 2 THEN ts WHEN 3 THEN ts END AS t FROM events""",
)
def mixed_timestamps(spark, sf_dir):
    """Epoch milliseconds, epoch seconds, ISO with an offset, ISO without one, and unreadable text."""
    e = tb.table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp_ntz"))
    us, k = tp.micros(F.col("t")), F.col("event_id") % 5
    shape = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    text = (
        F.when(k == 0, F.floor(us / 1000).cast("string")).when(k == 1, F.floor(us / 1_000_000).cast("string"))
        .when(k == 2, F.concat(F.date_format(F.col("t") + F.expr("INTERVAL '2' HOUR"), shape), F.lit("+02:00")))
        .when(k == 3, F.date_format("t", shape)).otherwise(F.lit("yesterday"))
    )
    rows = e.select("event_id", text.alias("text"))
    return rows.select("event_id", tp.plus_micros(tp.mixed_micros(F.col("text"))).alias("t"))


# ---- result logs, caches and sinks ----------------------------------------------------------------


@query(
    "result_log_rows",
    sql("""SELECT model, CAST(seed AS INTEGER) AS seed, source, target, protocol, CAST(format('{:.4f}', pr_auc) AS DOUBLE) AS pr_auc,
        CAST(format('{:.3f}', lift) AS DOUBLE) AS lift FROM results WHERE pr_auc IS NOT NULL""", "results"),
)
def result_log_rows(spark, sf_dir):
    """Result lines written as a text log, soft-wrapped for odd seeds, with an earlier run that must lose."""
    path = work_path(spark, "log")
    r = result_table(spark, sf_dir).filter("pr_auc IS NOT NULL")
    proto = F.when(F.col("source") == F.col("target"), F.concat(F.lit(" ["), "protocol", F.lit("]"))).otherwise("")
    head = F.concat(F.col("model"), F.lit(" seed="), "seed", F.lit(" "), "source", F.lit("->"), "target", proto, F.lit(":"))
    now = F.format_string("pr_auc=%.4f lift=%.3f", "pr_auc", "lift")
    wrap = F.when(F.col("seed") % 2 == 1, "\n   ").otherwise(" ")
    old = F.concat(head, F.lit(" pr_auc=0.5000 lift=1.000"))
    r.select(F.concat_ws("\n", old, F.lit("INFO scoring"), F.concat(head, wrap, now)).alias("value")).write.text(path)
    return resultlog.parse(resultlog.read_lines(spark, path))


@query(
    "event_cache_reuse",
    sql("SELECT dataset, day, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos FROM strict_sample GROUP BY ALL", "strict_sample"),
)
def event_cache_reuse(spark, sf_dir):
    """Sampled events cached by domain and day; the second call reads the cache and prunes by domain."""
    root = work_path(spark, "event-cache")
    calls = []

    def build():
        calls.append(1)
        return sm.uniform_sample(labelled_events(spark, sf_dir), F.col("action") == "http", 0.05)

    cache.cached_events(spark, root, "all", 0.05, build, grain="month")
    again = cache.cached_events(spark, root, "all", 0.05, build, grain="month")
    if len(calls) != 1:
        raise RuntimeError("the cache was built twice")
    return again.groupBy("dataset", "day").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("n_pos")
    )


@query(
    "prediction_sink",
    sql("""SELECT f.fmt, dataset AS source, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(n_events) AS DOUBLE) AS total
        FROM ud, (SELECT unnest(['parquet', 'csv']) AS fmt) f GROUP BY ALL""", "ud"),
)
def prediction_sink(spark, sf_dir):
    rows = user_days(spark, sf_dir, staged=True).select(
        F.lit("volume").alias("model"), F.col("dataset").alias("source"), F.col("dataset").alias("target"),
        F.lit(0).alias("seed"), "user", "day", F.col("n_events").cast("double").alias("score"), "label",
    )
    out = None
    for fmt in ("parquet", "csv"):
        path = work_path(spark, f"predictions-{fmt}")
        cache.write_predictions(rows, path, fmt)
        cache.write_predictions(rows.filter("source <> 'retail'"), path, fmt)  # written again: replaced, not doubled
        back = spark.read.option("header", True).format(fmt).load(path)
        part = back.groupBy("source").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("n_pos"),
            F.sum(F.col("score").cast("double")).alias("total"),
        ).select(F.lit(fmt).alias("fmt"), "source", "n", "n_pos", "total")
        out = part if out is None else out.unionByName(part)
    return out
