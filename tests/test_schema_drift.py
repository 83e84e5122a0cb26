import json

from terravane.operators.schema_drift import WAYPOINT_LOGS, all_steps, consistent_readings, migration_steps, profiles, unmapped_names, values, version_rules, versions

SCHEMA = "file_id bigint, logger_id string, survey_id string, written_at timestamp, received_at timestamp, line_no bigint, payload string, header string, fields string"


def logs(spark, files):
    from datetime import datetime, timedelta

    rows = []
    for n, lines in enumerate(files):
        at = datetime(2024, 1, 1) + timedelta(days=n)
        rows += [(n, "L", "S", at, at, k, x if isinstance(x, str) or x is None else json.dumps(x), "?", "?") for k, x in enumerate(lines)]
    return spark.createDataFrame(rows, SCHEMA)


def test_changes_and_readings(spark):
    files = [
        [{"rec": "h", "coord_order": "lat_lon"}, {"frame": 1, "time_s": 1.5, "latitude": 45.1, "longitude": 29.1, "rtk_q": 1}, {"frame": 1, "time_s": 1.5, "latitude": 45.1, "longitude": 29.1, "rtk_q": 1}],
        [{"rec": "h", "coord_order": ["lon", "lat"]}, {"frame": 2, "time_ms": 2500, "pos": [29.2, 45.2], "abs_alt": "n/a"}, {"frame": 3, "time_ms": 2600, "pos": [29.2, 45.2], "abs_alt": 7.0}, {"frame": 4, "abs_alt": 8.0}],
        [{"rec": "h"}, {"frame": "5", "time_ms": "3000", "pos": "45.3,29.3", "abs_alt": None, "relHeightFt": 10.0}, "not json", "[1]", None],
    ]
    got = {(r.file_id, r.field_name, r.change) for r in migration_steps(logs(spark, files)).collect()}
    expected = {(1, "latlon_order", "type_changed"), (1, "time_s", "renamed"), (1, "absolute_altitude_m", "added"), (1, "rtk_q", "removed")}
    expected |= {(1, f, c) for f in ("latitude", "longitude") for c in ("renamed", "type_changed")}
    expected |= {(2, "latlon_order", "removed"), (2, "frame_id", "type_changed"), (2, "time_s", "type_changed"), (2, "latitude", "type_changed"), (2, "longitude", "type_changed"), (2, "absolute_altitude_m", "removed"), (2, "relative_altitude_m", "added")}
    assert got == expected
    rows = {r.frame_id: r for r in consistent_readings(logs(spark, files)).collect()}
    assert len(rows) == 5 and (rows[2].latitude, rows[2].longitude, rows[2].time_s) == (45.2, 29.2, 2.5)
    assert rows[2].absolute_altitude_m is None and rows[4].absolute_altitude_m == 8.0
    assert (rows[5].latitude, rows[5].longitude, round(rows[5].relative_altitude_m, 3)) == (45.3, 29.3, 3.048)


def test_empty_table(spark):
    empty = logs(spark, [[{"frame": 1}]]).limit(0)
    assert migration_steps(empty).count() == 0 and consistent_readings(empty).count() == 0


def test_chained_rules_lead_to_each_files_own_names(spark):
    files = [[{"rec": 1}, {"frame": 1, "lat": 1.5, "lon": 2.5, "rtk_q": 1}], [{"rec": 1}, {"frame": 1, "lat": 1.5, "lon": 2.5}], [{"rec": 1}, {"frame_no": 1, "gps": [1.5, 2.5]}], [{"rec": 1}, {"frame_no": 1, "gps": [1.5, 2.5]}], [{}, {}], [{}, {"frame": "1", "rtk_q": 1}]]
    found = values(logs(spark, files))
    schemas = profiles(found)
    marked = versions(logs(spark, files), schemas)
    rules = marked.join(version_rules(marked, all_steps(marked, schemas), WAYPOINT_LOGS), ["logger_id", "version"])
    got = {(r.file_id, r.field_name, r.rule, r.kind) for r in rules.collect()}
    assert got == {(r.file_id, r.field_name, r.raw_name, r.kind) for r in schemas.collect()} and len(got) == 15
    assert {r.file_id: r.version for r in marked.collect()} == {0: 1, 1: 2, 2: 3, 3: 3, 4: 4, 5: 5}


def test_of_two_aliases_the_rule_then_the_registry_decides(spark):
    files = [[{}, {"frame": 1, "lat": 1.0}, {"frame": 2, "lat": 2.0, "Latitude_deg": 9.0}, {"frame": 3, "Latitude_deg": 4.0, "gps_lat": 3.0}]]
    assert {r.frame_id: r.latitude for r in consistent_readings(logs(spark, files)).collect()} == {1: 1.0, 2: 2.0, 3: 3.0}


def test_unmapped_names_are_reported(spark):
    files = [[{"rec": "h", "new_order": 1, "coord_order": "x"}, {"frame": 1, "heightAGL": 2.0}, {"frame": 1, "heightAGL": 2.0}, {"frame": 2, "heightAGL": None, "lat": 3}, "not json", None]]
    assert {(r.file_id, r.header, r.raw_name, r.n) for r in unmapped_names(logs(spark, files)).collect()} == {(0, True, "rec", 1), (0, True, "new_order", 1), (0, False, "heightAGL", 1)}
    assert unmapped_names(logs(spark, files).limit(0)).count() == 0
