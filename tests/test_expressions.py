import pytest
from pyspark.sql import functions as F, types as T

from cohortspark.functions import outcome, packed, text
from cohortspark.functions.vectors import dot, l2_normalize


def one(spark, values, dtype, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("x", dtype)]))
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_yes_no(spark):
    words = ["1", "0", "2", "1.0", " Yes ", "n", "", None, "TRUE", "maybe", "+1", "01"]
    assert one(spark, words, T.StringType(), lambda c: text.yes_no(c, T.StringType())) == [
        "yes", "no", "no", "NA", "yes", "no", "NA", "NA", "yes", "NA", "yes", "yes"]
    numbers = [1.0, 0.0, 2.0, 1.9, None, float("nan"), -0.5, float("inf")]
    assert one(spark, numbers, T.DoubleType(), lambda c: text.yes_no(c, T.DoubleType())) == [
        "yes", "no", "no", "yes", "NA", "NA", "no", "NA"]


def test_band_gaps_go_to_the_last_label(spark):
    ages = [None, 17.9, 18.0, 39.0, 39.5, 64.5, 75.0, 84.0, 85.0, 40.0, 74.0]
    assert one(spark, ages, T.DoubleType(), text.band) == [
        "NA", "<18", "18–39", "18–39", "≥85", "≥85", "75–84", "75–84", "≥85", "40–64", "65–74"]


def test_numbers_as_text(spark):
    values = [5.0, 12345678.0, 0.0001, 0.00012345, 1e-05, 1.2345e-07, 1e16, 1.5e300, -12345678.25, 0.1, 123456789012345.6, 0.0, 9999999.0]
    got = one(spark, values, T.DoubleType(), lambda c: text.value_or_na(c, T.DoubleType()))
    assert got == [repr(v) for v in values]
    assert one(spark, [None, float("nan")], T.DoubleType(), lambda c: text.value_or_na(c, T.DoubleType())) == ["NA", "NA"]
    assert one(spark, [None, " ", " a "], T.StringType(), lambda c: text.value_or_na(c, T.StringType())) == ["NA", "NA", " a "]


def test_clean_and_ellipsis(spark):
    raw = ["  a\t b \n c  d ", None, "x" * 12, "abc  defghij"]
    assert one(spark, raw, T.StringType(), text.clean_text) == [" ".join((v or "").split()) for v in raw]
    assert one(spark, raw, T.StringType(), lambda c: text.ellipsis(c, 7)) == ["a b c d", "", "xxxx...", "abc..."]
    assert one(spark, raw[2:], T.StringType(), lambda c: text.truncate(c, 4)) == ["xxxx", "abc "]


def test_sanitize(spark):
    cases = [
        "[Case]\nx\n[Outcome]\nDied on day 4\nmore\n[Labs]\ny\n",
        "[Case]\nx\n[outcome]\nlast block",
        "a\r\nDeath Date: 1 In hospital death b\x0bc\n30-day mortality",
        "[Outcome]\nz\n[1x] not a header\n[B] header",
    ]
    assert one(spark, cases, T.StringType(), text.sanitize) == [
        "[Case]\nx\n[Labs]\ny\n", "[Case]\nx\n", "a\nIn hospital death\nb\nc\n", "[B] header\n"]


def test_packed(spark):
    values = ["m1{A:R; B:S} | m2{NA} | bad | m1{C:S}", "", None, "m{}", " g {Vancomycin : S ; Meropenem:R:x; none}"]
    got = one(spark, values, T.StringType(), lambda c: F.to_json(packed.last_of_group(packed.named_blocks(c))))
    assert got == ['[{"grp":"m2","items":[]},{"grp":"m1","items":["C:S"]}]', "[]", "[]", '[{"grp":"m","items":[]}]',
                   '[{"grp":"g","items":["Vancomycin : S","Meropenem:R:x","none"]}]']
    got = one(spark, values, T.StringType(), lambda c: F.to_json(packed.block_pairs(packed.named_blocks(c))))
    assert got[4] == '[{"name":"Meropenem","result":"R:x"},{"name":"Vancomycin","result":"S"}]'
    assert one(spark, [" b, a ,b,, c", None, ""], T.StringType(), packed.comma_list) == [["b", "a", "c"], [], []]


def test_leak_and_names(spark):
    names = ["P_1_22.narrative.md", "x-1.narrative.md", None, "_5.narrative.md", "a_b.narrative.md"]
    got = one(spark, names, T.StringType(), lambda c: F.concat_ws("/", *text.ids_from_name(c)))
    assert got == ["P_1/22", "NA/NA", "NA/NA", "NA/NA", "NA/NA"]
    assert one(spark, ["A.b", "axb", None], T.StringType(), lambda c: text.contains_text(c, "a.B")) == [True, False, False]
    assert one(spark, ["A.b", "axb", None], T.StringType(), lambda c: text.contains_text(c, "a.B", regex=True)) == [True, True, False]


def test_outcome_and_vectors(spark):
    df = spark.createDataFrame([(1.0, 1.0, -3.0), (0.0, 1.0, 5.0), (0.0, 0.0, None)], "e double, c double, t double")
    got = df.select(outcome.event_code(F.col("e"), F.col("c")), outcome.clip_low(F.col("t"), 0.0), outcome.clip_high(F.col("t"), 4.0)).collect()
    assert [tuple(r) for r in got] == [(1, 0.0, -3.0), (2, 5.0, 4.0), (0, None, None)]
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    unit = [r[0] for r in v.select(l2_normalize(F.col("v"))).collect()]
    assert unit == [[0.6, 0.8], [0.0, 0.0]]
    assert v.select(dot(F.col("v"), F.col("v"))).first()[0] == pytest.approx(25.0)


def test_batch_lists_are_those_of_the_expressions(spark):
    import random

    import pyarrow as pa

    draw = random.Random(7)
    pieces = ["Vancomycin", "Oxacillin", "Linezolid", ":", ":", ";", ";", "|", "|", "{", "}", "{na}", "{ NA }", " ", "\xa0", "\n", "S", "R", "é", ",", " ", "A{Oxacillin:S; Vancomycin : R}"]
    rows = [tuple(None if draw.random() < 0.1 else "".join(draw.choices(pieces, k=draw.randrange(14))) for _ in range(3)) for _ in range(600)]
    rows += [("a, b ,a,,　c", "A{Oxacillin:S}|B{na}|A{Vancomycin:R;Vancomycin:R;Oxacillin::}", "Oxacillin:S; Oxacillin:S"), ("", "A{Oxacillin:S\n;Vancomycin:S}", "Vancomycin:"),
             (" ", "x{Linezolid:S}", "Vancomycin:S;Oxacillin:R;Vancomycin:S")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, drugs string, grouped string, flat string").repartition(3)
    df = packed.with_blocks(df, "grouped", "_blocks").withColumn("_boxed", packed.block_pairs(F.col("_blocks")))
    flat = packed.shown(packed.flat_pairs(F.col("flat")))
    want = {False: F.when(F.size("_blocks") > 0, F.col("_boxed")).otherwise(flat),
            True: F.when(F.size("_boxed") > 0, F.col("_boxed")).otherwise(F.array_sort(F.array_distinct(flat)))}
    for on_pairs, pairs in want.items():
        got = df.select("i", packed.comma_list(F.col("drugs")).alias("a"), pairs.alias("b"), packed.episode_lists(F.col("drugs"), F.col("grouped"), F.col("flat"), on_pairs).alias("l"),
                        packed.episode_lists(F.col("drugs"), F.col("grouped"), F.col("flat"), on_pairs, True).alias("t")).collect()
        for r in got:
            assert r["l"]["drugs"] == r["a"] and r["l"]["pairs"] == r["b"], rows[r["i"]]
            assert r["t"]["drugs"] == ("\n".join(f"  o Antibiotic_{n}: {d}" for n, d in enumerate(r["a"], 1)) or None)
            assert r["t"]["pairs"] == ("\n".join(f"  o {p['name']}: {p['result']}" for p in r["b"]) or None)
        assert any(r["b"] for r in got)
    none = pa.array([], pa.string())
    assert len(packed.batch_lists(none, none, none, True, True)) == len(packed.batch_lists(none, none, none, False, False)) == 0


def test_rstrip(spark):
    values = ["a", "a ", " a\xa0\n", "　", "", None, "a​", "a b \t"]
    assert one(spark, values, T.StringType(), text.rstrip) == one(spark, values, T.StringType(), lambda c: F.rtrim(c, F.lit(text.SPACES)))


def test_audit_finds_terms_as_lowered_texts_hold_them(spark):
    import pyarrow as pa

    from cohortspark.operators import quality

    texts = ["MORTALITY", "morta", "lity", None, "", "in-hospital", "INHOSPITAL_MORTALITY x mortality", "Kİ Mortality_30D", "toKen", "TOKEN", "İd", "éÉ"]
    terms = ["mortality", "inhospital_mortality", "mortality_30d", "token", "i̇", "id", "é"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, own string").coalesce(1)
    want = {f"term:{t}": rows for t in terms if (rows := [r[0] for r in df.filter(F.lower("text").contains(t)).select("id").orderBy("id").collect()])}
    want["own_id"] = [6]
    assert {r["rule"]: (r["n"], r["first_id"]) for r in quality.leakage_audit(df, "text", "own", "id", terms).collect()} == {k: (len(v), v[0]) for k, v in want.items()}
    # a slice of a batch, and terms that would begin in one text and end in the next
    found = quality.rows_with(pa.array(texts, pa.string()).slice(1, 6), ["mortality", "inhospital_mortality"])
    assert [f.tolist() for f in found] == [[5], [5]]
