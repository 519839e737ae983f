"""The whole event rule against a plain version over lists, on random rows with small caps."""

import math
import random

import pytest

from contactsheet.operators import events

SCHEMA = "cam string, id long, taken_ts double, place_id long, city string, folder string, lat double, lon double"
CITY = {1: "A", 2: "A", 3: "B", 4: None}


def shots(seed, n):
    r = random.Random(seed)
    out, ts = [], {}
    for i in range(n):
        cam = r.choice(["x", "y", None])
        ts[cam] = ts.get(cam, 0.0) + r.choice([60, 600, 2800, 4000, 20_000, 40_000, 70_000])
        place = r.choice([1, 1, 2, 3, 4, None])
        at = (10.0 + 0.3 * r.randrange(3), 20.0) if r.random() < 0.5 else (None, None)
        out.append((cam, i, None if r.random() < 0.03 else ts[cam], place, CITY.get(place), r.choice(["f", "g", None]), *at))
    return out


def km(a, b):
    (x1, y1), (x2, y2) = [tuple(map(math.radians, p)) for p in (a, b)]
    h = math.sin((x2 - x1) / 2) ** 2 + math.cos(x1) * math.cos(x2) * math.sin((y2 - y1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(h))


def most(values):
    values = [v for v in values if v]
    return max(values, key=lambda v: (values.count(v), -values.index(v))) if values else None


def same_place(a, b):
    pa, pb = most([r[3] for r in a]), most([r[3] for r in b])
    if pa and pb and (pa == pb or (CITY[pa] and CITY[pa] == CITY[pb])):
        return True
    at = lambda rows: [(r[6], r[7]) for r in rows if r[6] is not None]
    if at(a) and at(b):
        return km(at(a)[-1], at(b)[0]) < 15
    return not pa or not pb


def plain(rows, cap):
    found = {}
    for cam in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == cam and r[2] is not None), key=lambda r: (r[2], r[1]))
        segments = []
        for r in own:
            if segments:
                last, gap = segments[-1][-1], r[2] - segments[-1][-1][2]
                split = gap > 2.5 * 3600 or (gap >= 2700 and last[6] is not None and r[6] is not None and km(last[6:], r[6:]) >= 30)
                full = len(segments[-1]) >= cap and last[2] // 86400 != r[2] // 86400
            if not segments or (split and gap >= 1200) or full or (split and len(segments[-1]) >= cap):
                segments.append([])
            segments[-1].append(r)
        sessions = []
        for s in segments:
            joins = False
            if sessions:
                gap, a, b = (s[0][2] - sessions[-1][-1][2]) / 3600, sessions[-1][-1][2] // 86400, s[0][2] // 86400
                joins = (a == b or gap <= 6) and gap <= 10 and same_place(sessions[-1], s) and len(sessions[-1]) + len(s) <= 2 * cap
            sessions[-1].extend(s) if joins else sessions.append(list(s))
        merged = []
        for s in sessions:
            joins = False
            if merged:
                p = merged[-1]
                joins = (s[0][2] - p[-1][2]) / 3600 <= 20 and same_place(p, s) and len(p) + len(s) <= 2 * cap and most([r[5] for r in p]) is not None and most([r[5] for r in p]) == most([r[5] for r in s])
            merged[-1].extend(s) if joins else merged.append(list(s))
        number = lambda groups: {r[1]: i for i, g in enumerate(groups) for r in g}
        a, b, c = number(segments), number(sessions), number(merged)
        found |= {i: (a[i], b[i], c[i]) for i in a}
    return found


@pytest.mark.parametrize(("seed", "cap"), [(1, 3), (2, 5), (3, 1200)])
def test_event_numbers_match_a_plain_version(spark, seed, cap):
    rows = shots(seed, 250)
    found = events.event_numbers(spark.createDataFrame(rows, SCHEMA), "cam", "id", cap=cap).collect()
    assert {r.id: (r.segment, r.session, r.event) for r in found} == plain(rows, cap)


def test_event_rows_of_nothing(spark):
    rows = spark.createDataFrame([], SCHEMA)
    assert events.event_rows(events.event_numbers(rows, "cam", "id"), rows, "cam", "id").count() == 0
