"""What a reviewer found in round 2: open ties, and many copies of one place."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from draftlens.functions import segments
from draftlens.operators import drawing, graph, inspection, ranking, review
from draftlens.plans import drawings, fixtures
from draftlens.plans import review as plans

SF01 = "/root/testdata/sf0.01"


def test_equal_labels_of_a_brand_have_fixed_places(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{SF01}/part.parquet'")
    want = sorted(con.execute(fixtures.ORACLES["label_places"]).fetchall())
    assert sorted(map(tuple, drawings.label_places(spark, SF01).collect())) == want
    # Two keys of one label (1372 div 7 = 1374 div 7), in either order of the file.
    for n, order in enumerate(("p_partkey", "p_partkey DESC")):
        (at := tmp_path / str(n)).mkdir()
        con.execute(f"COPY (SELECT * FROM part WHERE p_partkey IN (1372, 1374) ORDER BY {order}) TO '{at}/part.parquet'")
        assert {r.p_partkey: r.place for r in drawings.label_places(spark, str(at)).collect()} == {1374: 1, 1372: 2}


# Ways to thin out boxes, with the conflict each means.
DEDUPS = {
    "nms_final": (lambda d: ranking.dedupe_boxes(d.withColumn("down", -F.col("score")), ["down"], segments.same_place, looks_at=[]), lambda r: (-r[6], r[1]), lambda w, l, iou, inner: iou >= 0.3 or inner >= 0.8),
    "detector_nms": (lambda d: ranking.nms(d, 0.2), lambda r: (-r[6], r[1]), lambda w, l, iou, inner: iou >= 0.2),
    "position_dedupe": (ranking.final_positions, lambda r: (-r[6], (r[4] - r[2]) * (r[5] - r[3]), r[1]), lambda w, l, iou, inner: w[7] == l[7] and (iou >= 0.3 or inner >= 0.8)),
    "region_dedupe": (ranking.table_regions, lambda r: (-(r[4] - r[2]) * (r[5] - r[3]), r[1]), lambda w, l, iou, inner: w[2] <= l[2] and w[3] <= l[3] and w[4] >= l[4] and w[5] >= l[5] or iou > 0.8),
    "read_dedupe": (lambda d: ranking.read_texts(d, 0.15), lambda r: (-r[6], r[1]), lambda w, l, iou, inner: iou > 0.15),
}


@pytest.mark.parametrize("name", list(DEDUPS))
def test_equal_boxes_form_no_pairs(spark, monkeypatch, name):
    """300 copies of a box conflict with nothing that the best of them doesn't; boxes without area, and sides the wrong way round, stay as they are."""
    made, order, beats = DEDUPS[name]
    spots = [(0.0, 0.0, 30.0, 20.0), (4.0, 3.0, 34.0, 23.0), (20.0, 5.0, 50.0, 25.0), (21.0, 6.0, 40.0, 16.0)]
    rows = [(k % 2, k, *spots[k * 7 % 4], k * 37 % 101, "ab"[k % 3 // 2]) for k in range(2400)]
    rows += [(0, 5000 + k, 10.0, 10.0, 10.0, 15.0, k, "a") for k in range(3)] + [(0, 6000 + k, 9.0, 9.0, 8.0, 8.0, k, "a") for k in range(3)]
    boxes = spark.createDataFrame(rows, "page long, id long, x0 double, y0 double, x1 double, y1 double, score long, type string")
    boxes = boxes.withColumns({"syntax": F.lit("ok"), "text_length": F.col("score"), "confidence": F.lit(0.5), "eng_len": F.col("score"), "has_tolerance": F.lit(True), "geometric": F.lit(False)})
    counts, whole = [], ranking.survivors
    monkeypatch.setattr(ranking, "survivors", lambda items, conflicts: (counts.append(conflicts.count()), whole(items, conflicts))[1])

    def conflict(w, l):
        sx, sy = min(w[4], l[4]) - max(w[2], l[2]), min(w[5], l[5]) - max(w[3], l[3])
        aw, al = ((r[4] - r[2]) * (r[5] - r[3]) for r in (w, l))
        return w[0] == l[0] and min(sx, sy) >= 0 and beats(w, l, sx * sy / (aw + al - sx * sy or 1), sx * sy / (min(aw, al) or 1))

    want = []
    for r in sorted(rows, key=order):
        sound = r[2] <= r[4]
        if not (sound and any(conflict(w, r) for w in want if w[2] <= w[4])):
            want.append(r)
    assert sorted(r.id for r in made(boxes).collect()) == sorted(r[1] for r in want)
    assert counts[0] < 200


def test_points_at_one_spot_form_no_pairs(spark, monkeypatch):
    spots = [(0.0, 0.0), (3.0, 4.0), (8.0, 4.0), (20.0, 20.0), (13.0, 4.0), (24.0, 20.0), (40.0, 40.0), (41.0, 40.0)]
    rows = [(k % 2, k, *spots[k % 3]) for k in range(1500)] + [(1, 2000 + k, *spots[k]) for k in range(3, 8)] + [(None, 3000, 0.0, 0.0), (1, 3001, float("nan"), 0.0), (1, 3002, float("nan"), 0.0), (1, 3003, None, 0.0), (1, 3004, None, 0.0)]
    points = spark.createDataFrame(rows, "page long, id long, x double, y double")
    counts, whole = [], graph.near_pairs
    monkeypatch.setattr(graph, "near_pairs", lambda *a: (counts.append(whole(*a).count()), whole(*a))[1])
    for least in (1, 2, 3):
        got = {r.id: r.cluster for r in graph.dbscan(points, 5.0, least).collect()}
        near = lambda p, q: p[1] == q[1] or (p[0] == q[0] is not None and None not in (p[2], q[2]) and math.hypot(p[2] - q[2], p[3] - q[3]) <= 5)
        around = {p[1]: [q[1] for q in rows if near(p, q)] for p in rows}
        cluster = {i: i for i, them in around.items() if len(them) >= least}
        while (new := {i: min(cluster[q] for q in around[i] if q in cluster) for i in cluster}) != cluster:
            cluster = new
        assert got == {i: cluster.get(i, min((cluster[q] for q in around[i] if q in cluster), default=None)) for i in around}
    assert max(counts) < 30


def test_dots_at_one_spot_form_no_pairs(spark, monkeypatch):
    spots = [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (0.5, 1.5), (9.0, 9.0)]
    rows = [(k % 2, k, *spots[k * 3 % 5], k % 7 / 7, k * 31 % 11 / 11, k % 3 == 0) for k in range(1500)] + [(None, 2000, 0.0, 0.0, 0.0, 0.0, True), (None, 2001, 0.0, 0.0, 0.0, 0.0, True)]
    dots = spark.createDataFrame(rows, "page long, id long, x double, y double, top double, left double, high boolean")
    counts, whole = [], review.near_pairs
    monkeypatch.setattr(review, "near_pairs", lambda *a: (counts.append(whole(*a).count()), whole(*a))[1])
    want = []
    for r in sorted(rows, key=lambda r: (r[4], r[5], not r[6], r[1])):
        if not any(r[0] == w[0] is not None and math.hypot(r[2] - w[2], r[3] - w[3]) <= 1.2 for w in want):
            want.append(r)
    assert sorted(r.id for r in review.dedupe_dots(dots).collect()) == sorted(r[1] for r in want)
    assert counts[0] < 30


def test_equal_marks_and_labels_are_looked_up_once(spark, monkeypatch):
    rows = [(k % 2, k, 100.0 + k % 3, 50.0, 112.0 + k % 3, 58.0) for k in range(600)]
    frames = [(k % 2, 5000 - k, 80.0 - k % 4, 40.0, 130.0, 70.0 + k % 2) for k in range(600)]
    box = "page long, id long, x0 double, y0 double, x1 double, y1 double"
    counts, whole = [], review.box_join
    monkeypatch.setattr(review, "box_join", lambda *a: (counts.append(whole(*a).count()), whole(*a))[1])
    got = {(r.page, r.label_id): r.mark_id for r in review.enclosing_marks(spark.createDataFrame(rows + [(None, 7000, 100.0, 50.0, 112.0, 58.0), (0, 7001, 900.0, 50.0, 912.0, 58.0)], box), spark.createDataFrame(frames, box)).collect()}
    size = lambda m: ((m[4] - m[2]) * (m[5] - m[3]), m[4] - m[2] + m[5] - m[3], m[1])
    best = {p: min(size(m) for m in frames if m[0] == p)[-1] for p in (0, 1)}
    assert got == {(r[0], r[1]): best[r[0]] for r in rows} | {(None, 7000): None, (0, 7001): None}
    assert counts[0] < 100


def test_relations_are_judged_where_lines_meet(spark):
    """Only the grid's joins (small boxes, and large ones of either side) are left; before, each pair went on to two more."""
    rows = [(k % 2, k, 10.0 * (k % 3), 5.0, 10.0 * (k % 3) + 12 + k % 5, 5.0 + k % 4) for k in range(40)] + [(0, 100, -9000.0, 6.0, 9000.0, 6.0)]
    lines = spark.createDataFrame(rows, "page long, id long, x0 double, y0 double, x1 double, y1 double")
    lines.createOrReplaceTempView("_lines")
    got = review.line_pairs(lines)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3
    con = duckdb.connect()
    con.execute("CREATE TABLE l (page BIGINT, id BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)")
    con.executemany("INSERT INTO l VALUES (?, ?, ?, ?, ?, ?)", rows)
    want = con.execute(fixtures.ORACLES["line_relations"].replace(plans._LINES, "FROM l")).fetchall()
    assert sorted((*map(str, r[:-1]), round(r[-1], 6)) for r in got.collect()) == sorted((*map(str, r[:-1]), round(r[-1], 6)) for r in want)
    assert len(want) > 100


def test_regions_meet_only_views_and_cells_near_them(spark, monkeypatch):
    regions = [(k % 2, k, 100.0 * (k % 5), 10.0, 100.0 * (k % 5) + 60, 50.0) for k in range(400)] + [(0, 900, 5.0, 5.0, 5.0, 9.0), (0, 901, 9.0, 9.0, 1.0, 1.0), (None, 902, 0.0, 10.0, 60.0, 50.0)]
    views = [(k % 2, 100.0 * (k % 3) - 10 * (k % 4), 0.0, 100.0 * (k % 3) + 40, 60.0 - k % 7) for k in range(400)] + [(1, 300.0, 0.0, 330.0, 80.0), (0, -1.0, 0.0, 9000.0, 31.0), (0, 410.0, 10.0, 440.0, 50.0)]
    cells = [(0, 100.0 * k + d, 20.0, 100.0 * k + d + 9, 29.0) for k in (0, 2) for d in (0, 20)] + [(1, 5.0, 20.0, 14.0, 29.0)] * 2 + [(1, 105.0, 20.0, 114.0, 29.0)]
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n in ('page', 'id') else 'double'}" for n in names.split()))
    counts, whole = [], drawing.box_join
    monkeypatch.setattr(drawing, "box_join", lambda *a: (counts.append(whole(*a).count()), whole(*a))[1])
    got = drawing.table_regions_outside_views(frame(regions, "page id x0 y0 x1 y1"), frame(views, "page x0 y0 x1 y1"), frame(cells, "page x0 y0 x1 y1"), least_cells=2)

    def kept(page, _, x0, y0, x1, y1):
        area = (x1 - x0) * (y1 - y0)
        shares = [max(0, min(x1, v[3]) - max(x0, v[1])) * max(0, min(y1, v[4]) - max(y0, v[2])) / area for v in views if v[0] == page and area > 0]
        return max(shares, default=0) < 0.5 or sum(c[0] == page and x0 <= (c[1] + c[3]) / 2 <= x1 and y0 <= (c[2] + c[4]) / 2 <= y1 for c in cells) >= 2

    want = [r[1] for r in regions if kept(*r)]
    assert sorted(r.id for r in got.collect()) == sorted(want) and 3 < len(want) < 300
    assert max(counts) < 300


def _match(spark, marks, records):
    made = lambda rows, names: spark.createDataFrame(rows, names)
    return inspection.match_by_number(made(marks, "uuid long, stamp_no string"), made(records, "record_id long, no string"))


@pytest.mark.parametrize("sizes", [(2, 3), (1, 1), (512, 1024)])
def test_blocks_match_each_mark_with_each_record_of_its_number(spark, monkeypatch, sizes):
    """Repeated and null ids, numbers of one side only, and rows without a number."""
    monkeypatch.setattr(inspection, "BLOCK_MARKS", sizes[0], raising=False)
    monkeypatch.setattr(inspection, "BLOCK_RECORDS", sizes[1], raising=False)
    marks = [(k, f"{k % 3}") for k in range(20)] + [(7, "1")] * 3 + [(None, "2"), (None, "2"), (None, "8"), (None, None), (90, " 04 - 5"), (91, "6"), (92, "none"), (92, "none"), (93, None), (94, "")]
    records = [(1000 + k, f"0{k % 3}") for k in range(11)] + [(1001, "1")] * 4 + [(None, "1"), (None, "9"), (None, ""), (1090, "4-05"), (1091, "7"), (1092, ""), (1092, ""), (1093, None), (1094, "x")]
    con = duckdb.connect()
    con.execute("CREATE TABLE s (uuid BIGINT, k VARCHAR); CREATE TABLE r (record_id BIGINT, k VARCHAR)")
    key = lambda text: {"04 - 5": "4-5", "4-05": "4-5"}.get(t := (text or "").strip(), str(int(t)) if t.isdigit() else None)
    con.executemany("INSERT INTO s VALUES (?, ?)", [(i, key(no)) for i, no in marks])
    con.executemany("INSERT INTO r VALUES (?, ?)", [(i, key(no)) for i, no in records])
    want = con.execute("SELECT uuid, record_id, coalesce(s.k, r.k), CASE WHEN uuid IS NULL THEN 'unmatched' WHEN record_id IS NULL THEN 'not_found' ELSE 'matched_by_no' END FROM s FULL JOIN r ON s.k = r.k").fetchall()
    assert sorted(map(tuple, _match(spark, marks, records).collect()), key=repr) == sorted(want, key=repr)


def test_matches_of_one_number_are_dealt_over_tasks(spark):
    """Before, one task made all rows of a number and held them at once."""
    got = _match(spark, [(k, "7") for k in range(2000)], [(k, "07") for k in range(2100)])
    parts = got.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.sum("uuid").alias("u"), F.sum("record_id").alias("r")).collect()
    assert [sum(p[k] for p in parts) for k in ("n", "u", "r")] == [2000 * 2100, 1999 * 1000 * 2100, 2099 * 1050 * 2000]
    assert max(p.n for p in parts) < 2000 * 2100 / 2
