import random

from pyspark.sql import functions as F

from leafmill.operators import layout as L
from leafmill.operators import spatial as S

BOX, POINT = "page int, id int, x0 double, y0 double, x1 double, y1 double", "page int, id int, x double, y double"


def some(rnd, n):
    place = lambda: rnd.choice([rnd.uniform(-30, 300), float(rnd.randrange(0, 256, 32)), 0.0])
    out = []
    for i in range(n):
        x, y = place(), place()
        out.append((rnd.randint(1, 3), i, x, y, x + rnd.choice([0.0, 5.0, 32.0, 150.0, -10.0]), y + rnd.choice([0.0, 5.0, 32.0, 150.0])))
    return [*out, (None, n, 0.0, 0.0, 9.0, 9.0), (1, n + 1, None, 0.0, 9.0, 9.0), (1, n + 2, float("nan"), 0.0, 9.0, 9.0)]


def test_boxes_against_all_pairs(spark):
    a, b = some(random.Random(1), 120), some(random.Random(2), 80)
    good = lambda r: None not in r and r[2] == r[2]
    wanted = sorted((p[1], q[1]) for p in a for q in b if good(p) and good(q) and p[0] == q[0] and p[2] < q[4] and p[4] > q[2] and p[3] < q[5] and p[5] > q[3])
    one, other = spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX)
    for cell in (7.0, 32.0, 1000.0):
        assert sorted((r.a.id, r.b.id) for r in S.boxes_meet(one, other, cell).collect()) == wanted and len(wanted) > 100
    assert S.boxes_meet(one.limit(0), other).count() == 0


def test_points_against_all_boxes(spark):
    rnd = random.Random(3)
    points = [(rnd.randint(1, 4), i, rnd.choice([rnd.uniform(-30, 300), 32.0 * rnd.randint(0, 8)]), rnd.uniform(-30, 300)) for i in range(300)] + [(None, 900, 1.0, 1.0), (1, 901, None, 1.0)]
    boxes = [b for b in some(rnd, 20)]
    inside = lambda p, b: None not in (*p, *b) and p[0] == b[0] and b[2] <= p[2] <= b[4] and b[3] <= p[3] <= b[5]
    wanted = sorted(p[1] for p in points if not any(inside(p, b) for b in boxes))
    for cell in (7.0, 64.0):
        assert sorted(r.id for r in S.points_outside(spark.createDataFrame(points, POINT), spark.createDataFrame(boxes, BOX), cell).collect()) == wanted


def test_a_page_of_ten_thousand_words(spark):
    """What shares a cell is a small part of all pairs of the page."""
    words = spark.range(10_000).select(F.lit(1).alias("page"), (F.col("id") % 100 * 20.0).alias("x0"), (F.floor(F.col("id") / 100) * 20.0).alias("y0"), F.lit("7").alias("text"), F.lit(0.9).alias("conf"))
    words = words.withColumns({"x1": F.col("x0") + 8.0, "y1": F.col("y0") + 8.0})
    figures = spark.range(400).select(F.lit(1).alias("page"), F.col("id").alias("figure_id"), (F.col("id") % 20 * 100.0).alias("x0"), (F.floor(F.col("id") / 20) * 100.0).alias("y0"))
    figures = figures.withColumns({"x1": F.col("x0") + 60.0, "y1": F.col("y0") + 60.0})
    pairs = S.dealt(words).join(S.dealt(figures).select("page", "cx", "cy"), ["page", "cx", "cy"]).count()
    assert pairs < 10_000 * 400 / 40
    assert L.figure_callouts(words, figures).count() == 400
    assert S.boxes_meet(words, figures).count() == 400 * 9
