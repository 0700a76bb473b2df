"""Readers on small files of each log format, written by the tests."""

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from daymark import schema as sc
from daymark.sources import cache, cert, lanl, optc, registry, resultlog, spedia


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    if path.suffix == ".gz":
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)


@pytest.fixture()
def cert_dir(tmp_path):
    write(tmp_path / "logon.csv", "id,date,user,pc,activity\n"
          "1,01/02/2010 06:00:00,AA1,PC-1,Logon\n2,01/02/2010 20:00:00,AA1,PC-1,Logoff\n3,01/02/2010 09:00:00,BB2,PC-2,Reboot\n4,someday,BB2,PC-2,Logon\n")
    write(tmp_path / "device.csv", "id,date,user,pc,activity\n5,01/03/2010 10:00:00,AA1,PC-1,Connect\n6,01/03/2010 11:00:00,AA1,PC-1,Disconnect\n")
    write(tmp_path / "file.csv", "id,date,user,pc,filename,content\n7,01/03/2010 12:00:00,AA1,PC-1," + "x" * 200 + ',"a, b"\n')
    write(tmp_path / "email.csv", "id,date,user,pc,to,cc,bcc,from,size,attachments,content,activity\n"
          '8,01/04/2010 12:00:00,BB2,PC-2,"c@d,e@f",,,BB2,10,0,"line one\nline two, still",View\n9,01/04/2010 13:00:00,BB2,PC-2,g@h,,,BB2,10,0,x,Send\n')
    web = "".join(f"w{i},01/05/2010 08:00:{i % 60:02d},{'AA1' if i % 2 else 'BB2'},PC-1,http://x/{i},c\n" for i in range(400))
    write(tmp_path / "http.csv", "id,date,user,pc,url,content\n" + web)
    write(tmp_path / "answers/insiders.csv", "dataset,scenario,details,user,start,end\n4.2,1,x, AA1 ,s,e\n5.2,1,x,ZZ9,s,e\n")
    write(tmp_path / "answers/r4.2-1/r4.2-1-AA1.csv", 'device,{5},01/03/2010 10:00:00,AA1,PC-1,Connect\nemail,{8},01/04/2010 12:00:00,BB2,PC-2\n'
          "short,row\ndevice,{6},not a date,AA1\n")
    write(tmp_path / "answers/r4.2-2.csv", "logon,{1},01/02/2010 06:00:00,AA1,PC-1,Logon,extra,more\n")
    return str(tmp_path)


def test_cert_labels_actions_and_channels(spark, cert_dir):
    ev = cert.load(spark, cert_dir)
    assert sc.validate(ev) is ev
    got = {r["event_id"]: r for r in ev.collect()}
    assert set(got) == {"1", "2", "3", "5", "6", "7", "8", "9"}
    assert [got[i]["action"] for i in "1235678"] == ["logon", "logoff", "unknown", "usb_connect", "usb_disconnect", "file_write", "email_recv"]
    assert len(got["7"]["object"]) == 120 and got["8"]["object"] == "c@d,e@f" and got["9"]["action"] == "email_send"
    assert {i for i, r in got.items() if r["label"] == 1} == {"1", "2", "5", "6", "7"}  # AA1 on Jan 2 and 3; BB2 is not on the roster
    assert got["5"]["insider_type"] == "traitor" and got["8"]["insider_type"] == "benign"


def test_cert_web_modes(spark, cert_dir):
    web = lambda **kw: cert.load(spark, cert_dir, sources=(), **kw).filter("action = 'http'")
    assert web(http="all").count() == 400
    assert web(http="head", http_rows=25).count() == 25
    kept = web(http="uniform", http_fraction=0.2)
    loose = web(http="roster", http_fraction=0.2)
    assert 40 < kept.count() < 130
    assert loose.filter("user = 'AA1'").count() == 200
    assert loose.filter("user = 'BB2'").count() == kept.filter("user = 'BB2'").count()
    with pytest.raises(ValueError):
        web(http="some")


def test_cert_releases_are_separate_domains(spark, cert_dir):
    out = cert.load_releases(spark, {"one": (cert_dir, "4.2"), "two": (cert_dir, "5.2")}, answers=f"{cert_dir}/answers")
    pos = {r["dataset"]: r["p"] for r in out.groupBy("dataset").agg(F.sum("label").alias("p")).collect()}
    assert pos == {"one": 5, "two": 0}


@pytest.mark.parametrize("suffix", ["txt", "txt.gz"])
def test_lanl(spark, tmp_path, suffix):
    write(tmp_path / f"auth.{suffix}", "1,U1@DOM1,U1@DOM1,C1,C2,NTLM,Network,LogOn,Success\n"
          "86401,U1@DOM1,U1@DOM1,C1,C3,Kerberos,Batch,TGS,Fail\n2,C123@DOM1,C123@DOM1,C1,C2,?,?,LogOn,Success\n"
          "3,SRV$@DOM1,SRV$@DOM1,C1,C2,?,?,LogOff,Success\nx,U2@DOM1,U2@DOM1,C1,C2,?,?,LogOff,Success\n5,U2@DOM1,U2@DOM1,C1,C2,?,?,LogOff,Success\n")
    write(tmp_path / "redteam.txt", "86500,U1@DOM1,C1,C9\n999999,U7@DOM1,C1,C9\n")
    got = sorted(lanl.load(spark, str(tmp_path), mode="all").collect(), key=lambda r: r["timestamp"])
    assert [(r["user"], r["action"], r["label"], r["insider_type"]) for r in got] == [
        ("U1", "logon", 0, "benign"), ("U2", "logoff", 0, "benign"), ("U1", "auth", 1, "masquerader")]
    assert got[0]["timestamp"] == dt.datetime(2015, 1, 1, 0, 0, 1) and got[2]["object"] == "Kerberos:Batch:Fail"
    assert lanl.load(spark, str(tmp_path), mode="roster", fraction=0.0).count() == 2
    assert lanl.load(spark, str(tmp_path), mode="head", rows=1).count() == 1
    assert lanl.load(spark, str(tmp_path), mode="all", keep_machines=True).count() == 5


@pytest.fixture()
def optc_dir(tmp_path):
    def rec(i, ts, host, obj, act, principal="", **props):
        return json.dumps({"timestamp": ts, "id": i, "hostname": host, "object": obj, "action": act, "principal": principal, "properties": props})

    lines = [
        rec("a", "2019-09-23T11:00:00.000-04:00", "SysClient0201.systemia.com", "PROCESS", "CREATE", "SYSTEMIACOM\\zleazer", command_line="cmd.exe"),
        rec("b", "2019-09-23T12:30:00.000-04:00", "SysClient0201.systemia.com", "FLOW", "START", "NT AUTHORITY\\SYSTEM", direction="outbound", dest_ip="10.0.0.9", src_ip="10.0.0.1", dest_port="22"),
        rec("c", "2019-09-23T09:00:00.000-04:00", "SysClient0201.systemia.com", "USER_SESSION", "LOGIN", "", requesting_user="zleazer"),
        rec("d", "2019-09-23T15:00:00.000-04:00", "SysClient0300", "MODULE", "LOAD", "", module_path="C:\\x.dll"),
        rec("e", 1569254400000, "SysClient0201", "FILE", "DELETE", "bob@corp"),
        '{"broken": ', "", "not json",
    ]
    write(tmp_path / "ecar/evaluation/x/one.json.gz", "\n".join(lines[:4]))
    write(tmp_path / "ecar/benign/two.jsonl", "\n".join(lines[4:]))
    write(tmp_path / "ecar/evaluation/short/skip.json", lines[0])
    write(tmp_path / "ecar/evaluation/ecar-bro/skip.json", lines[0])
    write(tmp_path / "ecar/evaluation/readme.txt", lines[0])
    write(tmp_path / "redteam_intervals.csv", "Host,begin,finish\nSysClient0201,2019-09-23T17:00:00Z,2019-09-23T16:00:00Z\n"
          "SysClient0201.systemia.com,2019-09-23T16:15:00Z,2019-09-23T16:45:00Z\n,2019-09-23T16:15:00Z,2019-09-23T16:45:00Z\n")
    return tmp_path


def test_optc_events(spark, optc_dir):
    got = {r["event_id"]: r for r in optc.load(spark, str(optc_dir), fraction=None).collect()}
    assert set(got) == {"a", "b", "c", "d", "e"}
    assert {i for i, r in got.items() if r["label"] == 1} == {"b", "e"}  # 16:30 and 16:00 UTC
    assert got["b"]["action"] == "ssh" and got["b"]["dst_host"] == "10.0.0.9" and got["b"]["user"] == "zleazer"
    assert got["d"]["action"] == "unknown" and got["d"]["user"] == "host:SysClient0300" and got["d"]["object"] == "C:\\x.dll"
    assert got["a"]["user"] == "zleazer" and got["e"]["user"] == "bob" and got["c"]["action"] == "logon"
    assert got["a"]["timestamp"] == dt.datetime(2019, 9, 23, 15, 0) and got["e"]["object"] == "unknown"
    only = optc.load(spark, str(optc_dir), fraction=0.0)
    assert {r["event_id"] for r in only.collect()} == {"b", "e"}


def test_optc_interval_shapes(spark, tmp_path):
    write(tmp_path / "days/redteam.csv", "hostname,day\nH1.x,2019-09-24\nH2,never\n")
    got = optc.read_intervals(spark, str(tmp_path / "days")).collect()
    assert [(r["host"], r["start"], r["end"]) for r in got] == [("H1", dt.datetime(2019, 9, 24), dt.datetime(2019, 9, 24, 23, 59, 59, 999999))]
    write(tmp_path / "none/redteam.csv", "hostname,day\nH2,never\n")
    with pytest.raises(ValueError):
        optc.read_intervals(spark, str(tmp_path / "none"))
    write(tmp_path / "nohost/redteam.csv", "machine,day\nH2,2019-09-24\n")
    with pytest.raises(ValueError):
        optc.read_intervals(spark, str(tmp_path / "nohost"))
    with pytest.raises(FileNotFoundError):
        optc.read_intervals(spark, str(tmp_path / "empty/deep"))


SPEDIA = ["Agent_name", "User", "Timestamp", "Decoder_name", "Description", "Full_log", "Content", "Url", "To", "Cc", "Bcc", "From", "Attachments",
          "Size", "Size_before", "Size_after", "Filename", "Path", "Command", "Level", "Activity", "Action"]


def test_spedia(spark, tmp_path):
    def row(**kw):
        return ",".join('"' + str(kw.get(c, "")) + '"' for c in SPEDIA)

    rows = [
        row(Agent_name="h", User="a", Timestamp="2023-01-01 10:00:00", Decoder_name="cert", Description="Highly Suspicious", Level="3", Activity="Command", Command="rm"),
        row(Agent_name="h", User="", Timestamp="2023-01-01 11:00:00", Decoder_name="", Description="MIDLY suspicious\nmore", Level="3", Activity="file", Action="Modified", Path="/etc"),
        row(Agent_name="h", User="b", Timestamp="2023-01-01 12:00:00", Decoder_name="pam", Description="Lowly Suspicious", Level="7", Activity="Session", Action="Login failed"),
        row(Agent_name="h", User="b", Timestamp="2023-01-01 13:00:00", Decoder_name="pam", Description="", Level="8", Activity="device", Action="Disconnected"),
        row(Agent_name="h", User="b", Timestamp="later", Decoder_name="pam", Description="", Level="8", Activity="device", Action="x"),
    ]
    write(tmp_path / "s.csv", ",".join(SPEDIA) + "\n" + "\n".join(rows) + "\n")
    got = sorted(spedia.load(spark, str(tmp_path / "s.csv")).collect(), key=lambda r: r["timestamp"])
    assert [r["label"] for r in got] == [1, 1, 0, 1]
    assert [r["action"] for r in got] == ["cmd_exec", "file_write", "auth", "usb_disconnect"]
    assert [r["object"] for r in got] == ["rm", "/etc", "unknown", "unknown"] and got[1]["user"] == "unknown"
    assert spedia.load(spark, str(tmp_path / "s.csv"), real_only=True).count() == 3  # a missing decoder is kept
    assert registry.load(spark, "spedia", str(tmp_path / "s.csv"), threshold="lowly").agg(F.sum("label")).first()[0] == 4
    with pytest.raises(ValueError):
        registry.load(spark, "twos", "x")


def test_result_log(spark, tmp_path):
    write(tmp_path / "r.log", "noise\nrf seed=0 a->b: pr_auc=0.10 lift=2.0\nrf seed=0 a->a [temporal]:\n  pr_auc=0.50 lift=5.0\nrf seed=1 a->a: pr_auc=0.9 lift=9\n"
          "rf seed=0 b->a: pr_auc=0.30\n   lift=3.5\nrf seed=0 a->b: pr_auc=0.20 lift=4.0\n")
    got = {(r["seed"], r["source"], r["target"], r["protocol"]): (r["pr_auc"], r["lift"]) for r in resultlog.parse(resultlog.read_lines(spark, str(tmp_path))).collect()}
    assert got == {(0, "a", "b", "full_source"): (0.2, 4.0), (0, "a", "a", "temporal"): (0.5, 5.0), (0, "b", "a", "full_source"): (0.3, 3.5)}


def test_cache_without_positives_is_refused(spark, tmp_path):
    quiet = spark.createDataFrame([("d", "u", 0)], "dataset string, user string, label int").withColumn("timestamp", F.lit("2024-01-01").cast("timestamp_ntz"))
    with pytest.raises(ValueError):
        cache.cached_events(spark, str(tmp_path), "d", 0.02, lambda: quiet)
    assert cache.cache_name("d", 0.02) == "events_d_bf002"


def test_exercise_loader_keeps_the_common_contract(spark, tmp_path):
    from daymark.operators.features import base_features
    from daymark.schema import EVENT_COLUMNS
    from daymark.sources import registry

    (tmp_path / "a.csv").write_text(
        "Agent_name,User,Timestamp,Decoder_name,Description,Level,Activity,Action,Command,Url,Filename,Path\n"
        "h1,u1,2024-01-02 03:04:05,x,\"two\nlines\",3,Logon,Logon,,,,\n"
        "h1,u1,2024-01-02 04:04:05,x,d,3,Logon,Logon,,,,\n")
    events = registry.load(spark, "spedia", str(tmp_path))
    assert events.columns == [*EVENT_COLUMNS, "event_id", "day"]
    assert len({r["event_id"] for r in events.collect()}) == 2
    row = base_features(events).first()
    assert row["n_events"] == 2 and str(row["day"]) == "2024-01-02"


def test_an_empty_port_gives_way_to_the_other_field(spark, optc_dir):
    lines = [json.dumps({"timestamp": "2019-09-23T12:00:00.000-04:00", "id": i, "hostname": "SysClient0201", "object": "FLOW", "action": "START",
                         "principal": "amy", "properties": {"direction": "outbound", "dest_ip": "10.0.0.9", **ports}})
             for i, ports in (("p", {"dest_port": " ", "dst_port": "22"}), ("q", {"dest_port": "", "dst_port": ""}), ("r", {"dest_port": "21", "dst_port": "22"}))]
    write(optc_dir / "ecar/benign/three.jsonl", "\n".join(lines))
    got = {r["event_id"]: r["action"] for r in optc.load(spark, str(optc_dir), fraction=None).collect()}
    assert (got["p"], got["q"], got["r"]) == ("ssh", "http", "ftp")


def test_written_cells_are_replaced_and_others_stay(spark, tmp_path):
    from daymark.sources import cache

    schema = "model string, source string, target string, seed int, user string, day string, score double, label int"
    rows = spark.createDataFrame([("m", "a", "b", 0, "u", "d", 1.0, 0), ("m", "a", "c", 0, "u", "d", 2.0, 1)], schema)
    path = str(tmp_path / "p")
    assert cache.read_table_or_none(spark, path) is None
    cache.write_predictions(rows, path)
    cache.write_predictions(rows.filter("target = 'b'").withColumn("score", rows["score"] + 5), path)
    assert sorted((r["target"], r["score"]) for r in cache.read_table_or_none(spark, path).collect()) == [("b", 6.0), ("c", 2.0)]
