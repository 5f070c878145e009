"""One pass over the log: what it counts, and that the job makes no other."""

from __future__ import annotations

import datetime
import json
import re

import pytest
from pyspark.sql import functions as F

from flowsieve import FlowAnalyzer
from flowsieve.operators import networks, report, rulesets, traffic, usage
from flowsieve.plans import job
from flowsieve.plans.sections import LogSections
from flowsieve.sources.parts import read_list_parts, write_list_parts
from flowsieve.sources.sinks import write_log, write_log_table
from flowsieve.sources.tables import invalid_values, load_logs
from workload import views

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def scans(spark, df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan")


@pytest.fixture(scope="module")
def flows(spark):
    return views.dirty_flows(spark, SF)


@pytest.fixture(scope="module")
def sections(flows):
    return LogSections(flows)


def test_one_scan_makes_all_sections(spark, sections):
    counts = sections.counts()
    counts.collect()
    assert scans(spark, counts) == 1 and len(sections.sections) == 9


def test_sections_equal_the_operators_on_the_log(sections, flows):
    assert rows(sections.of("flow")) == rows(traffic.summarise_flows(flows))
    for section, columns in (("source", ["src_ip"]), ("port", ["dst_port"]), ("pair", ["src_ip", "dst_ip"])):
        assert rows(sections.of(section)) == rows(flows.groupBy(*columns).count())
    assert rows(traffic.traffic_by_hour(sections.of("hour"))) == rows(traffic.traffic_by_hour(flows))
    assert rows(traffic.traffic_by_zone(sections.of("zones"))) == rows(traffic.traffic_by_zone(flows))
    assert rows(sections.after_hours()) == rows(traffic.after_hours(flows))
    assert sections.after_hours().columns == flows.columns
    assert rows(traffic.top_pairs(sections.of("pair"))) == rows(traffic.top_pairs(flows))


def test_a_minimal_log_has_fewer_sections(make_flows):
    flows = make_flows([("10.0.0.1", "10.0.0.2", 1), ("10.0.0.1", "10.0.0.2", 1), (None, None, None)]).drop("rule_name")
    sections = LogSections(flows)
    assert set(sections.sections) == {"plain_flow", "pair", "source", "destination", "port"}
    assert rows(sections.of("plain_flow")) == [("10.0.0.1", "10.0.0.2", 1, 2), (None, None, None, 1)]
    with pytest.raises(ValueError, match="zones"):
        sections.of("zones")
    assert LogSections(flows.limit(0)).of("pair").collect() == []


def test_analyzer_equals_the_operators(spark, flows):
    rules = views.rules(spark, SF)
    analyzer = FlowAnalyzer(flows, rules)
    assert analyzer.get_basic_stats().first() == traffic.basic_stats(flows).first()
    assert analyzer.optimize_single_rule().first() == rulesets.aggregate_single_rule(flows).first()
    assert rows(analyzer.generate_lean_rule_set()) == rows(rulesets.generate_lean_rule_set(flows))
    assert rows(analyzer.generate_optimized_rules()) == rows(usage.generate_optimized_rules(flows, rules))
    assert rows(analyzer.invalid_ips()) == rows(networks.invalid_ips(flows))
    assert json.loads(analyzer.generate_report().first()[0]) == json.loads(report.report_json(flows).first()[0])
    skipped = networks.invalid_ips(flows).groupBy("reason").agg(F.sum("rows").alias("rows")).collect()
    assert analyzer.rejects() == {"rows": 2 * flows.count(), **{r.reason: r.rows for r in skipped}}
    given = spark.createDataFrame([("192.168.0.0/16",)], "cidr string")
    labels = analyzer.label_addresses(given)
    assert labels.where("given").select("cidr").distinct().collect()[0].cidr == "192.168.0.0/16"


def read_by(events, path):
    """Names of the jobs' executions whose plan reads `path`, from the event log."""
    found = set()
    for line in events.read_text().splitlines():
        event = json.loads(line)
        if "sparkPlanInfo" in event and event["Event"].endswith("SparkListenerSQLExecutionStart"):
            nodes, seen = [event["sparkPlanInfo"]], 0
            while nodes:
                node = nodes.pop()
                seen += node["nodeName"].startswith("Scan") and path in json.dumps(node.get("metadata", {}))
                nodes += node["children"]
            if seen:
                found.add((event["executionId"], seen))
    return found


SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from flowsieve.plans import job
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
    .config("spark.checkpoint.dir", {scratch!r}).config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", {events!r})
    .config("spark.eventLog.rolling.enabled", "false").config("spark.eventLog.compress", "false").getOrCreate())
job.run(spark, {log!r}, {out!r}, report_tables=True)
spark.stop()
"""


def test_the_job_scans_the_log_once(spark, flows, tmp_path):
    """By the event log of a session of its own: two reads of the header line, one of the rows."""
    import os
    import subprocess
    import sys

    write_log(flows.drop("event_id"), str(tmp_path / "log.csv"), "csv")
    (tmp_path / "events").mkdir()
    script = SCRIPT.format(repo=os.getcwd(), scratch=str(tmp_path / "scratch"), events=f"file://{tmp_path}/events", log=str(tmp_path / "log.csv"), out=str(tmp_path / "out"))
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    (events,) = (tmp_path / "events").iterdir()
    # the header is found by a job that takes one line as text
    reads = [(e, n) for e, n in read_by(events, "log.csv") if n]
    text = events.read_text()
    csv_scans = {json.loads(line)["executionId"] for line in text.splitlines() if '"sparkPlanInfo"' in line and re.search(r'"Format": ?"CSV"', line) and "log.csv" in line}
    assert len(csv_scans) == 1 and all(n == 1 for e, n in reads if e in csv_scans)


def test_rows_that_do_not_fit_the_header(spark, tmp_path):
    head = "timestamp,source.ip,destination.port,destination.ip,rule.name\n"
    good = '2031-03-04T05:06:07Z,172.20.1.1,8443,172.20.9.9,"a, ""b"""\n2031-03-04T05:06:08Z,172.20.1.2,99,172.20.9.9,5" pipe\n2031-03-04T05:06:08Z,172.20.1.3,99\n'
    surplus = "2031-03-04T05:06:09Z,172.20.1.4,1,172.20.9.9,x,lost\n"
    broken = '2031-03-04T05:06:10Z,172.20.1.5,2,172.20.9.9,"two\nlines"\n"odd\ntime",172.20.1.6,3,172.20.9.9,x\n'
    (tmp_path / "log.csv").write_text(head + good + surplus + broken)
    path = str(tmp_path / "log.csv")
    found = {r.src_ip: (r.dst_port, r.dst_ip, r.rule_name) for r in load_logs(spark, path).collect()}
    # of the two broken rows, the line with the addresses is the flow
    assert found == {"172.20.1.1": (8443, "172.20.9.9", 'a, "b"'), "172.20.1.2": (99, "172.20.9.9", '5" pipe'), "172.20.1.3": (99, None, None),
                     "172.20.1.5": (2, "172.20.9.9", "two"), "172.20.1.6": (3, "172.20.9.9", "x")}
    assert {(r["column"], r.text) for r in invalid_values(spark, path).collect()} == {
        ("row", surplus.strip()), ("row", 'lines"'), ("row", '"odd'), ("ts", 'time"')}
    lines = {r.src_ip: r for r in load_logs(spark, path, multi_line=True).collect()}
    assert set(lines) == {"172.20.1.1", "172.20.1.2", "172.20.1.3", "172.20.1.5", "172.20.1.6"}
    assert lines["172.20.1.5"].rule_name == "two\nlines" and lines["172.20.1.6"].ts is None
    assert {(r["column"], r.text) for r in invalid_values(spark, path, multi_line=True).collect()} == {("row", surplus.strip()), ("ts", "odd\ntime")}
    analyzer = FlowAnalyzer.from_files(spark, path)
    assert analyzer.get_basic_stats().first().total_log_entries == 5 == analyzer.flows.count()
    assert rows(analyzer.invalid_values()) == rows(invalid_values(spark, path))
    assert analyzer.sections.after_hours().count() == 4


def test_parquet_is_the_default_log(spark, flows, tmp_path):
    path = str(tmp_path / "log")
    write_log(flows.drop("event_id"), path)
    assert rows(load_logs(spark, path, "parquet")) == rows(flows.drop("event_id"))
    with pytest.raises(ValueError, match="xml"):
        write_log(flows, path, "xml")


def test_a_bucketed_log_folds_without_shuffling_addresses(spark, flows, tmp_path):
    from flowsieve.operators import labels

    for name, log in (("log_by_day", flows), ("log_plain", flows.drop("ts"))):
        write_log_table(log, name, 4, str(tmp_path / name))
        table = spark.table(name)
        assert table.count() == flows.count()
        folded, labelled = networks.folded_sources(table), labels.labelled_sources(table)
        assert rows(folded) == rows(networks.networks_in_blocks(flows, ip="src_ip")) and rows(labelled) == rows(labels.ip_to_cidr(flows, ip="src_ip"))
        for df in (folded, labelled):
            plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert not re.search(r"Exchange hashpartitioning\((ip|addr|src_ip)", plan)
            # what is shuffled has one row per block: its summary, or its networks
            for line in (x for x in plan.splitlines() if re.search(r"(?<!Broadcast)(?<!Reused)Exchange", x)):
                assert "hashpartitioning(block" in line or "SinglePartition" in line
        spark.sql(f"DROP TABLE {name}")


def test_lists_of_any_length_are_written_in_order(spark, tmp_path, monkeypatch):
    from flowsieve.sources import parts

    monkeypatch.setattr(parts, "FILE_RECORDS", 3)
    numbers = spark.range(12_345).select(F.when(F.col("id") < 7000, "source").otherwise("destination").alias("side"), F.col("id"))
    listed = numbers.select("side", F.when(F.col("side") == "source", F.col("id")).otherwise(F.col("id") - 7000).alias("pos"), F.concat(F.lit("n"), "id").alias("cidr"))
    path = str(tmp_path / "lists")
    write_list_parts(listed.repartition(7), path, "side")
    assert rows(read_list_parts(spark, path, "side string")) == rows(listed)
    manifest = spark.read.json(f"{path}/manifest").orderBy("file").collect()
    assert sum(m.members for m in manifest) == 12_345 and len(manifest) >= 4
    lines = [json.loads(x) for m in manifest for x in (tmp_path / "lists" / "parts" / m.file).read_text().splitlines()]
    assert [(x["side"], x["first"]) for x in lines] == sorted((x["side"], x["first"]) for x in lines)
    assert max(len(x["members"]) for x in lines) == 1000
    assert [n for x in lines if x["side"] == "source" for n in x["members"]] == [f"n{i}" for i in range(7000)]


def test_a_report_of_very_many_networks_stays_small(spark, tmp_path):
    """300,000 networks: the report says how many, the lists have them all."""
    wide = spark.range(300_000).select(F.expr("concat_ws('.', (id * 700 + 16777216) >> 24, ((id * 700 + 16777216) >> 16) & 255, ((id * 700) >> 8) & 255, (id * 700) & 255)").alias("src_ip"),
                                       F.lit("10.0.0.1").alias("dst_ip"), F.lit(443).alias("dst_port"))
    analyzer = FlowAnalyzer(wide)
    text = analyzer.generate_report(str(tmp_path / "report")).first()[0]
    rule = json.loads(text)["optimized_single_rule"]
    assert rule == {"source_address": "300000 networks", "destination_address": "10.0.0.1/32", "service": "https", "log_count": 300_000}
    assert len(text) < 5000
    analyzer.write_report_lists(str(tmp_path / "lists"))
    back = read_list_parts(spark, str(tmp_path / "lists" / "single_rule_networks"), "side string")
    assert back.where("side = 'source'").agg(F.count("*"), F.count_distinct("value"), F.max("pos")).first()[:] == (300_000, 300_000, 299_999)
    assert max(len(x) for p in (tmp_path / "lists" / "single_rule_networks" / "parts").glob("part-*") for x in p.read_text().splitlines()) < 40_000


def test_hits_are_written_back(spark, make_flows, tmp_path, monkeypatch):
    from flowsieve.sources import sinks, swap
    from flowsieve.sources.tables import load_rules

    head = "rule_name,hits,priority,description,source_address,destination_address,service,risky_permissive,modified_date\n"
    (tmp_path / "rules.csv").write_text(head + 'zeta,5,3,"says ""no"", twice",any,any,any,risky,2030-02-01\nalpha,,1,,any,"10.0.0.0/8, 10.1.0.0/16",http,,\n')
    path = str(tmp_path / "rules.csv")
    flows = make_flows([("1.1.1.1", "2.2.2.2", 1, "zeta")] * 3 + [("1.1.1.1", "2.2.2.2", 1, "other")])
    before = {r.rule_name: r for r in load_rules(spark, path).collect()}
    sinks.write_back_hits(spark, flows, path, str(tmp_path / "counted"))
    assert [(r.rule_name, r.hits) for r in load_rules(spark, str(tmp_path / "counted")).collect()] == [("zeta", 3), ("alpha", 0)]
    sinks.write_back_hits(spark, flows, path, add=True)
    after = load_rules(spark, path).collect()
    assert [(r.rule_name, r.hits) for r in after] == [("zeta", 8), ("alpha", 0)]
    for r in after:
        assert r.asDict() | {"hits": None} == before[r.rule_name].asDict() | {"hits": None}
    sinks.write_back_hits(spark, flows, path, add=True)
    assert {r.rule_name: r.hits for r in load_rules(spark, path).collect()} == {"zeta": 11, "alpha": 0}

    def dies(session, files, new, target):
        assert files.rename(target, swap._beside(session, target, swap._OLD))
        raise KeyboardInterrupt

    monkeypatch.setattr(swap, "_swap", dies)
    with pytest.raises(KeyboardInterrupt):
        sinks.write_back_hits(spark, flows, path, add=True)
    monkeypatch.undo()
    sinks.write_back_hits(spark, flows, path)
    assert {r.rule_name: r.hits for r in load_rules(spark, path).collect()} == {"zeta": 3, "alpha": 0}
    assert {f.name for f in tmp_path.iterdir() if "flowsieve" in f.name} == set()


def test_job_counts_what_it_left_out(spark, tmp_path):
    (tmp_path / "log.csv").write_text("source.ip,destination.ip,destination.port\n10.1.2.3,10.1.2.4,99999\n10.1.2.3,x,22\na,b,1,surplus\n")
    job.run(spark, str(tmp_path / "log.csv"), str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out/invalid_values"))) == [("dst_port", "99999", 1), ("row", "a,b,1,surplus", 1)]
    assert [r.ip for r in spark.read.parquet(str(tmp_path / "out/invalid_ips")).collect()] == ["x"]
    assert (tmp_path / "out/report_lists/single_rule_networks/manifest/_SUCCESS").exists()
    assert datetime.date.today()
