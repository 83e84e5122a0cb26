from datetime import datetime, timezone

import numpy as np
import pytest

from terravane.operators.wall_clock import ABSOLUTE, LOCAL, NONE, clock_rule, instants, parse, parser_of, to_utc, zone_data_version, zone_table


def ms(*args):
    return int(datetime(*args, tzinfo=timezone.utc).timestamp() * 1000)


@pytest.mark.parametrize(
    ("text", "value", "kind"),
    [
        ("2023-05-17T19:45:25", ms(2023, 5, 17, 19, 45, 25), LOCAL),
        ("2023-05-17 19:45:25.5", ms(2023, 5, 17, 19, 45, 25) + 500, LOCAL),
        ("2023-137T19:45:25.25", ms(2023, 5, 17, 19, 45, 25) + 250, LOCAL),
        ("20230517T194525", ms(2023, 5, 17, 19, 45, 25), LOCAL),
        ("2023/5/7 1:02:03", ms(2023, 5, 7, 1, 2, 3), LOCAL),
        ("17.05.2023 19:45:25,718", ms(2023, 5, 17, 19, 45, 25) + 718, LOCAL),
        ("17/05/2023 19:45:25", ms(2023, 5, 17, 19, 45, 25), LOCAL),
        ("05/17/2023 7:45:25 PM", ms(2023, 5, 17, 19, 45, 25), LOCAL),
        ("05/17/2023 12:45:25 AM", ms(2023, 5, 17, 0, 45, 25), LOCAL),
        ("May 7, 2023 12:45:25 PM", ms(2023, 5, 7, 12, 45, 25), LOCAL),
        ("17 September 2023 19:45:25", ms(2023, 9, 17, 19, 45, 25), LOCAL),
        ("2023-05-17T19:45:25Z", ms(2023, 5, 17, 19, 45, 25), ABSOLUTE),
        ("2023-05-17 19:45:25 +05:30", ms(2023, 5, 17, 14, 15, 25), ABSOLUTE),
        ("2023-05-17T19:45:25-0330", ms(2023, 5, 17, 23, 15, 25), ABSOLUTE),
        ("2023-05-17 19:45:25 MDT", ms(2023, 5, 18, 1, 45, 25), ABSOLUTE),
        ("17 May 2023 19:45:25 GMT", ms(2023, 5, 17, 19, 45, 25), ABSOLUTE),
        ("1684352725", 1684352725000, ABSOLUTE),
        ("1684352725.25", 1684352725250, ABSOLUTE),
        ("1684352725123", 1684352725123, ABSOLUTE),
        ("1684352725123000", 1684352725123, ABSOLUTE),
        ("GPS week 2153 tow 256004.874", 315964800000 + 2153 * 604800000 + 256004874 - 18000, ABSOLUTE),
        ("wk=2153;tow=256004.874", 315964800000 + 2153 * 604800000 + 256004874 - 18000, ABSOLUTE),
        ("2153 256004.874 GPST", 315964800000 + 2153 * 604800000 + 256004874 - 18000, ABSOLUTE),
        ("no fix", 0, NONE),
        ("0000-00-00 00:00:00", None, NONE),
        ("2023-13-01 00:00:00", None, NONE),
        ("2023-05-17 19:45:25 XYZ", None, NONE),
    ],
)
def test_parse(text, value, kind):
    got, kinds = parse(np.array([text, "--", text]))
    assert list(kinds) == [kind, NONE, kind]
    if kind:
        assert got[0] == got[2] == value


def test_each_mask_has_one_parser():
    assert parser_of("9999-99-99a99:99:99")[0] == "iso" and parser_of("a a") is None and parser_of("") is None
    assert parse(np.array([], dtype="U1"))[0].size == 0


def test_zones():
    changes, offsets = zone_table("Europe/Berlin", zone_data_version())
    assert ms(2023, 3, 26, 1) in changes and set(offsets) == {3600000, 7200000}
    first, second = to_utc(np.array([ms(2023, 10, 29, 2, 30), ms(2023, 7, 1, 2, 30)]), "Europe/Berlin")
    assert list(first) == [ms(2023, 10, 29, 0, 30), ms(2023, 7, 1, 0, 30)] and list(second) == [ms(2023, 10, 29, 1, 30), -1]
    first, second = to_utc(np.array([ms(2024, 4, 7, 1, 45)]), "Australia/Lord_Howe")  # half an hour back
    assert second[0] - first[0] == 1800000
    assert clock_rule("gps time") == ("fixed", 18000) and clock_rule("UTC-03:30") == ("fixed", -12600000) and clock_rule("nowhere") is None
    assert zone_table("No/Such", "x") is None


def test_repeated_hour_is_decided_by_the_sequence(spark):
    marks = [(1, "A", 1, "29.10.2023 02:30:00"), (2, "A", 2, " 29.10.2023 02:10:00\t"), (3, "A", 3, "29.10.2023 03:10:00"), (3, "A", 3, "29.10.2023 03:10:00")]
    marks += [(4, "B", 1, "29.10.2023 02:30:00"), (5, "C", 1, "29.10.2023 02:30:00"), (6, "D", 1, "29.10.2023 02:30:00"), (7, "D", 1, "2023-10-29 02:30:00 +02:00"), (8, "A", 1, None), (9, "A", 9, "")]
    m = spark.createDataFrame(marks, "mark_id bigint, survey_id string, frame_id bigint, wall_text string").withColumnRenamed("survey_id", "survey_id")
    r = spark.createDataFrame([("A", "Europe/Berlin", 0.0), ("A", "Europe/Berlin", 0.0), ("B", "Europe/Berlin", 1.5), ("C", None, 0.0), ("D", "Europe/Berlin", None)], "survey_id string, clock string, clock_offset_s double")
    w = spark.createDataFrame([("A", 1, 0.0), ("A", 2, 2400.0), ("A", 3, 6000.0), ("B", 1, 5.0)], "survey_id string, frame_id bigint, time_s double")
    names = dict(mark="mark_id", source="survey_id", event="frame_id", text="wall_text", clock="clock", offset="clock_offset_s", time="time_s")
    got = {x.mark_id: x.utc_ms for x in instants(m, r, w, **names).collect()}
    # B leaves both hours possible; C has no clock, D no offset but one text with its own zone
    assert got == {1: ms(2023, 10, 29, 0, 30), 2: ms(2023, 10, 29, 1, 10), 3: ms(2023, 10, 29, 2, 10), 7: ms(2023, 10, 29, 0, 30)}
    assert instants(m.limit(0), r, w, **names).count() == 0


def test_texts_of_any_length():
    digits = "2023-05-17T19:45:25." + "5" * 5000
    got, kinds = parse([digits, "x" * 3_000_000, "9" * 100_000, "", "2153 GPS 5", digits])
    assert list(kinds) == [LOCAL, NONE, NONE, NONE, ABSOLUTE, LOCAL]
    assert got[0] == got[5] == ms(2023, 5, 17, 19, 45, 25) + 556
