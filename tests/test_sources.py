from __future__ import annotations

import datetime
import json
import os

import pytest

from flowsieve import FlowAnalyzer
from flowsieve.plans import job
from flowsieve.sources.scratch import new_scratch_path, scratch_folder, scratch_scope
from flowsieve.sources.sinks import extract_minimal_fields
from flowsieve.sources.tables import invalid_values, load_logs, load_rules

LOG = """timestamp,source.ip,host.collector,destination.port,destination.ip,observer.egress.zone,observer.ingress.zone,rule.name
2031-11-05T22:15:40Z,10.44.0.6,north,443,203.0.113.5,wan,lab,browse
2031-11-05T22:15:41Z,10.44.0.7,north,443.0,203.0.113.5,wan,lab,browse
not a time,NaN,north,,10.0.0.1,wan,lab,
"""
RULES = '''rule_name,hits,priority,description,recommended_action,source_zone,source_address,destination_zone,destination_address,application,service,url_category,action,profile_group,options,modified_date,created_date,risky_permissive,ingress_egress
browse,77,1,Pages for the lab,None,lab,any,wan,any,browser,any,any,allow,plain,"keep, rotate",2031-05-09,2030-12-24,permissive,ingress
names,0,2,"ask ""both"" servers",Tighten,lab,any,wan,"198.51.100.1, 198.51.100.2",resolver,dns,any,allow,plain,"keep, rotate",2030-07-31,2029-03-03,risky,egress
'''


@pytest.fixture()
def files(tmp_path):
    (tmp_path / "log.csv").write_text(LOG)
    (tmp_path / "rules.csv").write_text(RULES)
    return tmp_path


def test_log_columns_bind_by_name(spark, files):
    (files / "short.csv").write_text("destination.port,extra,destination.ip,source.ip\n80,e,10.0.0.2,10.0.0.1\n")
    row = load_logs(spark, str(files / "short.csv")).first()
    assert (row.src_ip, row.dst_ip, row.dst_port, row.extra) == ("10.0.0.1", "10.0.0.2", 80, "e")


def test_log_types_and_nulls(spark, files):
    logs = load_logs(spark, str(files / "log.csv"))
    assert dict(logs.dtypes)["ts"] == "timestamp_ntz" and dict(logs.dtypes)["dst_port"] == "int"
    first, second, third = logs.collect()
    assert first.ts == datetime.datetime(2031, 11, 5, 22, 15, 40)
    assert second.dst_port == 443
    assert (third.ts, third.src_ip, third.dst_port, third.rule_name) == (None, None, None, None)


def test_offsets_and_odd_ports(spark, files):
    rows = ["2025-04-07T01:00:00+05:00,443.7", "2025-04-07 01:00:00-0230,-5", "2025-04-07T01:00:00,99999999", "2025-04-07T01:00:00Z,65535", ",0.00"]
    text = "timestamp,destination.port,source.ip,destination.ip\n" + "".join(f"{r},10.0.0.1,10.0.0.2\n" for r in rows)
    (files / "odd.csv").write_text(text)
    logs = load_logs(spark, str(files / "odd.csv"))
    hour = datetime.datetime
    assert sorted(((r.ts, r.dst_port) for r in logs.collect()), key=str) == sorted([
        (hour(2025, 4, 6, 20), None), (hour(2025, 4, 7, 3, 30), None), (hour(2025, 4, 7, 1), None), (hour(2025, 4, 7, 1), 65535), (None, 0)], key=str)
    bad = {(r["column"], r.text, r.rows) for r in invalid_values(spark, str(files / "odd.csv")).collect()}
    assert bad == {("dst_port", "443.7", 1), ("dst_port", "-5", 1), ("dst_port", "99999999", 1)}


def test_parquet_times_are_utc_in_any_session_zone(spark, files):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        spark.sql("SELECT timestamp'2025-04-07T10:00:00Z' AS timestamp, '1' AS `source.ip`, '2' AS `destination.ip`, 80 AS `destination.port`").write.parquet(
            str(files / "zone.parquet"))
        assert load_logs(spark, str(files / "zone.parquet"), "parquet").first().ts == datetime.datetime(2025, 4, 7, 10)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_missing_columns_are_named(spark, files):
    (files / "bad.csv").write_text("source.ip,port\n1.1.1.1,1\n")
    with pytest.raises(ValueError, match=r"destination\.ip.*destination\.port"):
        load_logs(spark, str(files / "bad.csv"))
    with pytest.raises(ValueError, match="format"):
        load_logs(spark, str(files / "bad.csv"), "xml")


def test_files_with_another_column_order_are_refused(spark, files):
    folder = files / "logs"
    folder.mkdir()
    (folder / "a.csv").write_text("source.ip,destination.ip,destination.port\n1.1.1.1,2.2.2.2,1\n")
    (folder / "b.csv").write_text("destination.ip,source.ip,destination.port\n2.2.2.2,1.1.1.1,1\n")
    with pytest.raises(Exception, match="header"):
        load_logs(spark, str(folder)).collect()


def test_rule_table(spark, files):
    browse, names = load_rules(spark, str(files / "rules.csv")).collect()
    assert (browse.options, browse.recommended_action, browse.source_address) == ("keep, rotate", None, "any")
    assert (browse.hits, browse.priority, browse.modified_date) == (77, 1, datetime.date(2031, 5, 9))
    assert (names.destination_address, names.description) == ("198.51.100.1, 198.51.100.2", 'ask "both" servers')
    (files / "twice.csv").write_text(RULES + RULES.splitlines()[1] + "\n")
    with pytest.raises(ValueError, match="browse"):
        load_rules(spark, str(files / "twice.csv"))


def test_minimal_fields_keep_the_header_names(spark, files):
    extract_minimal_fields(spark, str(files / "log.csv"), str(files / "slim"))
    lines = [line for part in sorted((files / "slim").glob("part-*")) for line in part.read_text().splitlines()]
    assert lines[0] == "source.ip,destination.ip,destination.port"
    assert lines[1] == "10.44.0.6,203.0.113.5,443"
    assert load_logs(spark, str(files / "slim")).count() == 3


def test_parquet_input(spark, files):
    load_logs(spark, str(files / "log.csv")).write.parquet(str(files / "log.parquet"))
    with pytest.raises(ValueError):
        load_logs(spark, str(files / "log.parquet"), "parquet")
    spark.read.csv(str(files / "log.csv"), header=True).write.parquet(str(files / "named.parquet"))
    assert load_logs(spark, str(files / "named.parquet"), "parquet").where("dst_port = 443").count() == 2


def test_scratch_uses_the_sessions_folder(spark):
    assert scratch_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_a_scope_removes_what_was_written_in_it(spark):
    def folders():
        return {f for f in os.listdir(scratch_folder(spark)) if f.startswith("flowsieve-")}

    before = folders()
    with pytest.raises(RuntimeError), scratch_scope(spark):
        spark.range(3).write.parquet(new_scratch_path(spark, "some"))
        assert folders() > before
        raise RuntimeError
    assert folders() == before


def test_job_leaves_no_scratch_tables(spark, files):
    before = set(os.listdir(scratch_folder(spark)))
    job.run(spark, str(files / "log.csv"), str(files / "out"))
    assert set(os.listdir(scratch_folder(spark))) == before


def test_rule_names_are_needed_before_anything_is_written(spark, files):
    (files / "short.csv").write_text("destination.port,destination.ip,source.ip\n80,10.0.0.2,10.0.0.1\n")
    with pytest.raises(ValueError, match="rule_name"):
        job.run(spark, str(files / "short.csv"), str(files / "none"), str(files / "rules.csv"))
    assert not (files / "none").exists()
    with pytest.raises(ValueError, match="rule table"):
        FlowAnalyzer.from_files(spark, str(files / "short.csv")).analyze_rule_usage()


def test_job_writes_every_output(spark, files):
    out = str(files / "out")
    job.run(spark, str(files / "log.csv"), out, str(files / "rules.csv"), report_tables=True)
    assert sorted(os.listdir(out)) == [
        "after_hours", "analysis_report", "invalid_ips", "invalid_values", "lean_rules", "optimized_rules", "permissive_rules",
        "report_lists", "report_rows", "rule_networks", "rule_pattern_values", "rule_patterns", "single_rule_networks", "traffic_by_hour",
        "traffic_by_zone", "unused_rules", "visualizations"]
    assert [r.cidr for r in spark.read.parquet(f"{out}/single_rule_networks").where("side = 'source'").collect()] == ["10.44.0.6/31"]
    assert [tuple(r) for r in spark.read.parquet(f"{out}/invalid_values").collect()] == [("ts", "not a time", 1)]
    report = json.loads(spark.read.text(f"{out}/analysis_report").first()[0])
    assert report["basic_stats"]["total_log_entries"] == 3
    assert list(report["traffic_patterns"]["top_source_ips"]) == ["10.44.0.6", "10.44.0.7"]
    assert "unusual_ports" not in report["anomalies"]
    assert report["optimized_single_rule"]["source_address"] == "10.44.0.6/31"
    advice = {r.rule_name: r.recommendation for r in spark.read.json(f"{out}/optimized_rules").collect()}
    assert advice["names"] == "Consider removing this unused rule"
    assert spark.read.parquet(f"{out}/visualizations/graph_edges").count() == 2


def test_analyzer(spark, files):
    analyzer = FlowAnalyzer.from_files(spark, str(files / "log.csv"), str(files / "rules.csv"))
    assert analyzer.summary is analyzer.summary
    assert analyzer.get_basic_stats().first().total_log_entries == 3
    assert set(analyzer.analyze_traffic_patterns()) == {
        "top_source_ips", "top_destination_ips", "top_destination_ports", "top_source_dest_pairs"}
    assert analyzer.identify_anomalies()["low_occurrence_pairs"].count() == 2
    assert analyzer.generate_lean_rule_set().count() == 1
    assert analyzer.optimize_single_rule().first().service == "https"
    usage = analyzer.analyze_rule_usage()
    assert [r.rule_name for r in usage["unused_rules"].collect()] == ["names"]
    assert analyzer.report_rows().where("section = 'low_occurrence_total'").first()["count"] == 2
    assert analyzer.analyze_times_and_zones()["traffic_by_zone"].first()["count"] == 3
    with pytest.raises(ValueError, match="src_ip"):
        FlowAnalyzer(spark.range(1))
