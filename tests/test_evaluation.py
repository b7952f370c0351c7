import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import scalars as S
from gaugeworks.operators import evaluation, features, relations, sampling
from gaugeworks.spec import Channel, STUDIES, Study, splits

STUDY = Study("toy", "toy:", (Channel("temperature"), Channel("events", counter=True)), 10_000_000, splits(*[("2024-01-01", "2025-01-01")] * 4), cadence_text="ten seconds")


def windows(spark, values):
    rows = [(f"d{i}", [10_000_000 * k for k in range(28)], ["temperature", "events"], [v, v]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "device string, times_us array<long>, channels array<string>, values array<array<double>>")


def test_targets_follow_the_values(spark):
    up = [float(k) for k in range(28)]
    got = [r.target for r in features.labelled(windows(spark, [up, up[::-1]]), STUDY, "v").orderBy("device").collect()]
    assert got == ["temperature: rising; events: rising.", "temperature: falling; events: counter reset or decrease."]


def test_inputs_are_an_allowlist(spark):
    up = [float(k) for k in range(28)]
    e = features.examples(features.labelled(windows(spark, [up]), STUDY, "v"), STUDY)
    assert tuple(e.schema["inputs"].dataType.names) == features.INPUT_FIELDS
    row = e.select(F.to_json("inputs").alias("j"), "inputs").first()
    assert "d0" not in row.j and row.inputs.time_series_text[0].endswith("original standard deviation: 8.2259751.")
    assert abs(sum(row.inputs.time_series[0])) < 1e-4


def test_incomplete_channels_go(spark):
    up, bad = [float(k) for k in range(28)], [float("nan")] + [1.0] * 27
    df = windows(spark, [up]).withColumn("values", F.array(F.array(*map(F.lit, up)), F.array(*map(F.lit, bad))))
    assert features.labelled(df, STUDY, "v").count() == 0


@pytest.mark.parametrize(
    "text,ok",
    [("a: constant; b: rising.", True), ("a: constant.", False), ("a: constant; b: rising. More", False), ("a: constant; b: rising; c: falling", False), ("a: constant; a: rising", False), ("a: constant; b", False)],
)
def test_strict_answers(spark, text, ok):
    got = spark.createDataFrame([(text,)], "t string").select(S.parse_answer("t", F.array(F.lit("a"), F.lit("b")))).first()[0]
    assert (got == {"a": "constant", "b": "rising"}) if ok else got is None


def test_summary_counts_invalid_answers_as_wrong(spark):
    rows = [("1", ["a", "b"], "a: constant; b: rising.", "a: constant; b: rising."), ("2", ["a", "b"], "a: constant; b: rising.", "nothing")]
    scored = evaluation.scored(spark.createDataFrame(rows, "id string, ch array<string>, target string, output string"), "id", "ch", "target", "output")
    s = evaluation.summary(scored, "id").first()
    assert (s.windows, s.channel_labels, s.valid_output_rate, s.exact_window_accuracy, s.channel_accuracy, s.changed_channel_recall) == (2, 4, 0.5, 0.5, 0.5, 0.5)


def test_exact_sign_test(spark):
    gains = lambda *g: spark.createDataFrame([(x,) for x in g], "g double")
    five = evaluation.sign_test(gains(*[0.4] * 5), "g").first()
    assert (five.groups, five.probability) == (5, 1 / 32)
    assert evaluation.sign_test(gains(*[0.4] * 4), "g").first().probability == 1 / 16
    assert evaluation.sign_test(gains(0.4, 0.4, 0.4, 0.4, -0.1), "g").first().probability > 1 / 32


def test_bootstrap_of_a_constant_gain(spark):
    df = spark.createDataFrame([(i, 1.0, 0.0) for i in range(32)], "i int, a double, b double")
    assert tuple(evaluation.bootstrap_interval(df, "a", "b", "i").first()) == (1.0, 1.0)
    assert evaluation.bootstrap_interval(df.where("i < 0"), "a", "b", "i").count() == 0


def test_gate(spark):
    checks = spark.createDataFrame([("x", True), ("y", None)], "check string, ok boolean")
    assert evaluation.gate(checks).first().passed is False and evaluation.gate(checks.where("ok")).first().passed is True


def test_every_serial_has_one_split(spark):
    import hashlib

    ids = spark.createDataFrame([(f"fixture-{i}",) for i in range(300)], "serial string")
    got = {r.serial: r.split for r in sampling.with_split(ids, "serial", STUDIES["hdd"].salt, STUDIES["hdd"].splits).collect()}
    for serial, split in got.items():
        b = int(hashlib.sha256(f"hdd-split-v1:{serial}".encode()).hexdigest()[:8], 16) % 100
        assert split == ("train" if b < 60 else "validation" if b < 75 else "calibration" if b < 85 else "test")


def test_samples_ignore_input_order(spark):
    rows = [(f"g{i % 2}", f"w{i}") for i in range(10)]
    pick = lambda r: sorted(x.w for x in sampling.top_by_hash(spark.createDataFrame(r, "g string, w string"), ["g"], "w", "s:", 2).collect())
    assert pick(rows) == pick(rows[::-1]) and len(pick(rows)) == 4
    with pytest.raises(ValueError):
        sampling.top_by_hash(spark.createDataFrame(rows, "g string, w string"), ["g"], "w", "s:", 9, required=True)


def test_resume_is_the_suffix(spark):
    df = spark.createDataFrame([(f"w{i}",) for i in range(22)], "w string")
    full = sampling.shuffled(df, "w", 7).collect()
    rest = sampling.shuffled(df, "w", 7, after=full[9].place).collect()
    assert [r.w for r in rest] == [r.w for r in full[10:]] and len({r.w for r in full}) == 22


def test_unused_after_release(spark):
    rows = spark.createDataFrame([(f"w{i}", f"g{i % 5}") for i in range(6)], "w string, g string")
    opened = rows.where("w = 'w0'")
    assert relations.unused_after_release(rows, opened, "w", 6, "g").count() == 5
    for bad in (lambda: relations.unused_after_release(rows, opened, "w", 7, "g"), lambda: relations.unused_after_release(rows.unionByName(rows.limit(1)), opened, "w", 7, "g"), lambda: relations.unused_after_release(rows, rows.where("g = 'g1'"), "w", 6, "g")):
        with pytest.raises(Exception, match="release"):
            bad().collect()


def test_permutations_one_after_another(spark):
    rng, rows = np.random.default_rng(612), [(k, [float(100 * k + i) for i in range(28)]) for k in range(40)]
    want = {k: np.array(v)[rng.permutation(28)].tolist() for k, v in rows}
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (3, None)], "place long, value array<double>").repartition(7)
    got = evaluation.permuted_in_order(df, "value", "place").collect()
    assert {r.place: r.value for r in got if r.place is not None and r.value is not None} == want and sum(r.value is None for r in got) == 2


def test_first_batches(spark):
    rows = [(f, b, k) for f in range(3) for b in range(4) for k in range(5)]
    df = spark.createDataFrame(rows, "file int, batch int, k int")
    for least, n in ((1, 5), (5, 5), (6, 10), (21, 25), (60, 60), (1000, 60)):
        got = sorted(map(tuple, evaluation.first_batches(df, ["file", "batch"], least).collect()))
        assert got == rows[:n]
    assert not evaluation.first_batches(df.where("k > 9"), ["file", "batch"]).count()
