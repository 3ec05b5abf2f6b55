"""Two readers of one parts list: refs filled and repaired, quantities and rows compared.

The first reader gives rows in their printed order; the second reader's order is not trusted,
but a part number and what stands beside it come back together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.scalars import QUANTITY, description_words, part_key

#: Readings of the first reader are trusted from this confidence on.
SURE = 0.6


def second_reader(vision: DataFrame) -> DataFrame:
    """The second reader's parts by folded part number: list_id, key, v_seq, v_part, v_desc, v_ref, v_qty, single.

    vision(list_id, seq, ref, part_number, description, qty).  A row of several numbers with as many words
    gives each number its own word; of equal numbers the first stays."""
    tokens = F.filter(F.split(F.coalesce("part_number", F.lit("")), r"[\s/]+"), lambda t: part_key(t) != "")
    words = F.filter(F.split(F.trim(F.coalesce("description", F.lit(""))), r"\s+"), lambda w: w != "")
    flat = vision.withColumns({"tokens": tokens, "words": words}).select("*", F.posexplode("tokens").alias("nth", "token"))
    own = F.when((F.size("tokens") == F.size("words")) & (F.size("tokens") > 1), F.get("words", F.col("nth"))).otherwise(F.coalesce("description", F.lit("")))
    first = Window.partitionBy("list_id", "key").orderBy("seq", "nth")
    flat = flat.withColumn("key", part_key(F.col("token"))).withColumn("n", F.row_number().over(first)).where("n = 1")
    return flat.select("list_id", "key", F.col("seq").alias("v_seq"), F.col("token").alias("v_part"), own.alias("v_desc"), F.coalesce("ref", F.lit("")).alias("v_ref"), F.coalesce("qty", F.lit("")).alias("v_qty"), (F.size("tokens") == 1).alias("single"))


def matched(ocr: DataFrame, vision: DataFrame) -> DataFrame:
    """The first reader's rows with the second's beside them: + key, v_*, single, matched, name_ok.

    ocr(list_id, seq, ref, part_number, description, qty, conf).  Names agree if they share a word, or if the
    first reader has none, which then takes the second's.  Where they agree the second's spelling of the
    part number stays, since it keeps letters and digits apart."""
    both = ocr.withColumn("key", part_key(F.coalesce("part_number", F.lit("")))).join(second_reader(vision), ["list_id", "key"], "left")
    found = F.col("v_part").isNotNull() & (F.col("key") != "")
    blank = F.coalesce("description", F.lit("")) == ""
    same = found & (blank | F.arrays_overlap(description_words(F.coalesce("description", F.lit(""))), description_words(F.col("v_desc"))))
    both = both.withColumns({"matched": found, "name_ok": F.coalesce(same, F.lit(False))})
    return both.withColumns({
        "read_as": F.when(F.col("name_ok") & (F.col("v_part") != F.col("part_number")), F.col("part_number")),
        "part_number": F.when(F.col("name_ok"), F.col("v_part")).otherwise(F.col("part_number")),
        "description": F.when(F.col("name_ok") & blank, F.col("v_desc")).otherwise(F.coalesce("description", F.lit(""))),
    })


def filled_refs(rows: DataFrame) -> DataFrame:
    """Missing refs from the second reader, where they fit: + filled, fill.

    rows(list_id, seq, ref, second): second is the second reader's ref, blank if it has none for the row,
    NULL without a match.  A blank ``second`` marks an alternative part, and so does the ref of the row above.
    Else it is taken if it is a number above all refs before the row, below the next greater ref after it, and
    free.  fill: NULL (nothing was missing), ``alternative``, ``second reader`` or ``no ref``.

    Windows do it without a loop.  Between two printed refs the seconds that are taken must rise, and one that is
    not greater than all fitting ones before it cannot be: what was taken is the running maximum.
    """
    w = Window.partitionBy("list_id").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    number = lambda c: F.when(F.col(c).rlike(r"^\d+$"), F.col(c).cast("int"))
    r = rows.withColumns({"no": number("ref"), "want": F.when(F.coalesce("ref", F.lit("")) == "", number("second"))})
    r = r.withColumns({"low": F.coalesce(F.max("no").over(before), F.lit(0)), "later": F.collect_list("no").over(w.rowsBetween(1, Window.unboundedFollowing)), "used": F.collect_set("no").over(Window.partitionBy("list_id"))})
    after = F.get(F.filter("later", lambda x: x > F.col("low")), F.lit(0))
    fits = (F.col("want") > F.col("low")) & (after.isNull() | (F.col("want") < after)) & ~F.array_contains("used", F.col("want"))
    r = r.withColumn("fit", F.when(fits, F.col("want")))
    taken = F.col("fit").isNotNull() & (F.col("fit") > F.coalesce(F.max("fit").over(before), F.lit(0)))
    r = r.withColumn("filled", F.when(F.col("no").isNotNull(), F.col("ref")).when(taken, F.col("fit").cast("string")))
    above = F.last("filled", ignorenulls=True).over(before)
    second, missing = F.col("second"), F.col("no").isNull()
    fill = F.when(~missing, None).when(second == "", "alternative").when(second == above, "alternative").when(F.col("filled").isNotNull(), "second reader").otherwise("no ref")
    return r.withColumn("fill", fill).withColumn("filled", F.coalesce("filled", F.lit(""))).drop("no", "want", "low", "later", "used", "fit")


def with_repaired_refs(rows: DataFrame) -> DataFrame:
    """rows(list_id, seq, no, conf) -> list_id, seq, no, fixed, sure; one ordered fold for each list, inside the JVM.

    The count of refs must rise by one: a lone wrong ref between n and n + 2 is corrected, one out of order is
    cleared (and is no reference point any more), a real gap is kept.  A ref as read is sure from a confidence
    of ``SURE`` on, a corrected one always, a cleared one never."""
    lists = rows.groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct("seq", "no", "conf"))).alias("rows"))
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<struct<fixed:int,sure:boolean>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        no, after, last = x["no"], x["after"], a["last"]
        due = (no == last + 1) & (after.isNull() | (after > no))
        lone = after.isNotNull() & (after == last + 2) & (no != last + 1)
        wrong = (no <= last) | (after.isNotNull() & (no >= after))
        fixed = F.when(due, no).when(lone, last + 1).when(wrong, F.lit(None).cast("int")).otherwise(no)
        sure = F.when(due, x["conf"] >= SURE).when(lone, True).when(wrong, False).otherwise(x["conf"] >= SURE)
        return F.struct(F.coalesce(fixed, last).alias("last"), F.concat(a["out"], F.array(F.struct(fixed.alias("fixed"), F.coalesce(sure, F.lit(False)).alias("sure")))).alias("out"))

    seen = F.transform("rows", lambda r, i: F.struct(r["no"].alias("no"), r["conf"].alias("conf"), F.get(F.col("rows"), i + 1)["no"].alias("after")))
    folded = lists.withColumn("out", F.aggregate(seen, start, step, lambda a: a["out"]))
    flat = folded.select("list_id", F.explode(F.arrays_zip("rows", "out")).alias("z"))
    return flat.select("list_id", "z.rows.seq", "z.rows.no", "z.out.fixed", "z.out.sure")


def quantity(first: Column, second: Column) -> tuple[Column, Column]:
    """The quantity that stays, and a note on it (NULL: both agree)."""
    valid = lambda q: F.when(F.coalesce(q, F.lit("")).rlike(QUANTITY), q).otherwise("")
    a, b = valid(first), valid(second)
    differ = F.concat(F.lit("quantity uncertain: first reader "), a, F.lit(", second reader "), b)
    note = F.when((a != "") & (F.lower(a) == F.lower(b)), None).when((a != "") & (b != ""), differ).when(b != "", "quantity by second reader").when(a != "", "quantity by first reader").otherwise("quantity not readable")
    return F.when(a != "", a).otherwise(b), note


def judged(rows: DataFrame) -> DataFrame:
    """Of matched rows with their final ref and ``ref_ok``: list_id, seq, ref, part_number, description, qty, status, notes.

    ``confirmed``: part, name, ref and quantity agree; ``part confirmed``: all but the quantity."""
    qty, doubt = quantity(F.col("qty"), F.when(F.col("single"), F.col("v_qty")))
    rows = rows.withColumns({"final": qty, "doubt": doubt})
    good = F.col("matched") & F.col("name_ok") & F.col("ref_ok")
    status = F.when(good & F.col("doubt").isNull(), "confirmed").when(good, "part confirmed").otherwise("unconfirmed")
    notes = F.array_compact(F.array(
        F.when(~F.col("matched"), "first reader only").when(~F.col("name_ok"), F.concat(F.lit("name uncertain: second reader "), "v_desc")),
        F.when(F.col("read_as").isNotNull(), F.concat(F.lit("spelling by second reader, first reader "), "read_as")), "ref_note", "doubt",
    ))
    return rows.select("list_id", "seq", "ref", "part_number", "description", F.col("final").alias("qty"), status.alias("status"), notes.alias("notes"))


def second_only(rows: DataFrame, vision: DataFrame) -> DataFrame:
    """Rows that only the second reader saw, never confirmed: list_id, anchor, ref, part_number, description, qty.

    Its ref stays where no other row has it (of equal ones the first), and places the row before the first
    row with a greater ref; anchor is that row's seq, NULL for the end of the list."""
    v = vision.where("trim(coalesce(part_number, '')) <> '' AND NOT trim(part_number) RLIKE '\\\\s'").withColumn("key", part_key(F.col("part_number")))
    v = v.join(rows.select("list_id", part_key(F.col("part_number")).alias("key")).distinct(), ["list_id", "key"], "left_anti")
    once = lambda df, *by: df.withColumn("n", F.row_number().over(Window.partitionBy("list_id", *by).orderBy("seq"))).where("n = 1").drop("n")
    v = once(v, "key")
    taken = rows.where("ref <> ''").select("list_id", "ref").distinct()
    free = once(v.where(F.coalesce("ref", F.lit("")).rlike(r"^\d+$")).join(taken, ["list_id", "ref"], "left_anti"), "ref").select("list_id", "key", F.col("ref").alias("placed"))
    printed = rows.where("ref <> ''").groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("ref").cast("int").alias("no")))).alias("printed"))
    v = v.join(free, ["list_id", "key"], "left").join(printed, "list_id", "left")
    anchor = F.when(F.col("placed").isNotNull(), F.get(F.filter("printed", lambda p: p["no"] > F.col("placed").cast("int")), F.lit(0))["seq"])
    qty = F.when(F.coalesce("qty", F.lit("")).rlike(QUANTITY), F.col("qty")).otherwise("")
    return v.select("list_id", "seq", anchor.alias("anchor"), F.coalesce("placed", F.lit("")).alias("ref"), "part_number", F.coalesce("description", F.lit("")).alias("description"), qty.alias("qty"))


def scanned_list(ocr: DataFrame, vision: DataFrame) -> DataFrame:
    """A list read twice, whole: list_id, place, ref, part_number, description, qty, status, notes.

    Rows are matched by part number; missing refs are filled, then the count of refs is repaired, then every
    row is judged; rows of the second reader alone are placed by their ref."""
    rows = matched(ocr, vision).withColumn("second", F.when(F.col("matched") & F.col("name_ok"), F.col("v_ref")))
    rows = filled_refs(rows)
    fixed = with_repaired_refs(rows.where("filled <> ''").select("list_id", "seq", F.col("filled").cast("int").alias("no"), F.coalesce("conf", F.lit(1.0)).alias("conf")))
    rows = rows.join(fixed, ["list_id", "seq"], "left")
    moved = F.when(F.col("fixed").isNull(), F.concat(F.lit("ref read as "), F.col("no").cast("string"), F.lit(", out of order"))).when(F.col("fixed") != F.col("no"), F.concat(F.lit("ref read as "), F.col("no").cast("string")))
    fill = F.col("fill")
    rows = rows.withColumns({
        "ref": F.coalesce(F.col("fixed").cast("string"), F.lit("")),
        "ref_ok": F.when(fill == "alternative", True).when(F.col("no").isNull(), False).when(F.col("fixed").isNull(), False).otherwise(F.col("sure") | (F.coalesce(fill, F.lit("")) == "second reader")),
        "ref_note": F.concat_ws("; ", F.when(fill == "alternative", "alternative part").when(fill == "second reader", "ref by second reader").when(fill == "no ref", "no ref read"), F.when(F.col("no").isNotNull(), moved)),
    }).withColumn("ref_note", F.nullif("ref_note", F.lit("")))
    first = judged(rows)
    extra = second_only(first, vision)
    last = F.lit(None).cast("int")
    order = F.struct(F.col("seq").isNull().alias("end"), "seq", F.lit(1).alias("late"), F.lit(False).alias("loose"), last.alias("no"), last.alias("by"))
    placed = F.struct(F.col("anchor").isNull().alias("end"), F.col("anchor").cast("int").alias("seq"), F.lit(0).alias("late"), (F.col("ref") == "").alias("loose"), F.nullif("ref", F.lit("")).cast("int").alias("no"), F.col("seq").cast("int").alias("by"))
    columns = ["list_id", "at", "ref", "part_number", "description", "qty", "status", "notes"]
    both = first.withColumn("seq", F.col("seq").cast("int")).withColumn("at", order).select(columns)
    both = both.unionByName(extra.withColumn("at", placed).withColumns({"status": F.lit("unconfirmed"), "notes": F.array(F.lit("second reader only"))}).select(columns))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("list_id").orderBy("at"))).drop("at")
