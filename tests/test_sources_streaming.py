import datetime as dt
import hashlib
import io
import math
import struct
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import fleet, quality
from gaugeworks.sources import readers, writers
from gaugeworks.streaming import jobs

HEAD = "date,serial_number,model,capacity_bytes,failure,smart_5_raw\n"


def archive(path, **members):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "-") + ".csv", HEAD + body)
        z.writestr("__MACOSX/2018-02-25.csv", "x")
        z.writestr("notes.txt", "x")
    return str(path)


def test_zip_days(spark, tmp_path):
    p = archive(tmp_path / "a.zip", **{"2018__02__25": "2/25/18,drive,HDD,4.00079E+12,0,1\n2018-02-25,other,HDD,4000790000000,1,2\n2018-02-26,late,HDD,10,0,1\n2018-02-25,flag,HDD,10,2,1\n2018-02-25,,HDD,10,0,NA\n"})
    rows = readers.zip_drive_days(spark, p)
    good, bad = quality.quarantine(rows, quality.drive_day_rules(F.col("file_day")))
    got = sorted(good.select("serial_number", "date", "capacity_bytes", "smart_5_raw", "smart_187_raw").collect())
    assert [tuple(r) for r in got] == [("drive", dt.date(2018, 2, 25), 4000790000000, 1.0, None), ("other", dt.date(2018, 2, 25), 4000790000000, 2.0, None)]
    assert sorted(r.reason for r in bad.collect()) == ["date differs from file", "failure flag", "missing identity"]
    with pytest.raises(Exception, match="unknown date"):
        readers.zip_drive_days(spark, archive(tmp_path / "b.zip", **{"2018__02__25": "bad,drive,HDD,10,0,1\n"})).collect()


def test_preamble(spark, tmp_path):
    good, bad = tmp_path / "A_1_2018.csv", tmp_path / "B_1_2018.csv"
    good.write_text("# Time zone: UTC\n# Date and time,x\n2018-01-01 00:00:00,1.5\n")
    bad.write_text("# Date and time,x\n# Time zone: UTC\n2018-01-01 00:00:00,1.5\n")
    rows = readers.turbine_files(readers.preamble_csv(spark, str(good), "at string, x double")).collect()
    assert [(r.x, r.site, r.unit, r.year) for r in rows] == [(1.5, "A", "1", 2018)]
    with pytest.raises(Exception, match="no UTC header"):
        readers.preamble_csv(spark, str(bad), "at string, x double").collect()


def test_sound(spark, tmp_path):
    x = (np.sin(2 * np.pi * 500 * np.arange(160_000) / 16_000) * 0.5 * 32767).astype("<i2")
    for name in ("a.wav", "b.wav"):
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setparams((1, 2, 16_000, 0, "NONE", ""))
            w.writeframes(x.tobytes() if name == "a.wav" else (-x).tobytes())
    clips = readers.wav_pcm(spark, str(tmp_path / "*.wav"))
    frames = readers.sound_frames(readers.unique_clips(clips))
    r = frames.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.avg("low_band_rms").alias("low"), F.max("high_band_rms").alias("high")).first()
    assert r.n == 312 and abs(r.low - 0.5 / math.sqrt(2)) < 1e-3 and r.high < 1e-3
    twice = clips.unionByName(clips.limit(1))
    assert readers.unique_clips(twice).count() == 1


def test_attribute_blocks(spark):
    block = bytearray(362)
    block[2:14] = struct.pack("<BHBBIHB", 5, 0, 100, 99, 7, 1, 0)
    rows = readers.ata_attributes(spark.createDataFrame([(bytes(block),)], "block binary")).collect()
    assert [(r.id, r.normalized, r.raw) for r in rows] == [(5, 100, 7 + (1 << 32))]


def test_round_trip_and_refusal(spark, tmp_path):
    df = spark.range(50).withColumn("serial", F.concat(F.lit("s"), "id"))
    writers.by_bucket(df, str(tmp_path / "b"), "serial")
    back = spark.read.parquet(str(tmp_path / "b"))
    writers.verify(back.drop("bucket"), df)
    one = back.first().bucket
    assert readers.bucket_of(spark, str(tmp_path / "b"), one).count() == back.where(F.col("bucket") == one).count()
    with pytest.raises(ValueError):
        writers.verify(back.drop("bucket").where("id > 0"), df)
    with pytest.raises(Exception):
        writers.by_bucket(df, str(tmp_path / "b"), "serial")


def test_scores(spark):
    part = lambda t, series=None, static=None, smart=None: ("c", t, "c", static or {}, smart or {}, series or {}, None)
    rows = [("v", "agent", dt.datetime(2024, 1, 1), (f"m{i}", None, None, None, "medium", "s", "r", 1), [p]) for i, p in enumerate([
        part("cpu", {"temp_c": [95.0, 60.0]}), part("cpu", {"temp_c": [88.0]}), part("cpu", {"temp_c": [80.0]}), part("cpu", {"temp_c": [79.0]}),
        part("storage", smart={"reallocated_sectors": 3.0}), part("memory", static={"ecc_uncorrected": "1"}), part("power", {"voltage_v": [11.0, 13.0, 12.0]}),
    ])]
    a = {r.device: r for r in fleet.analyse(spark.createDataFrame(rows, fleet.RUN)).collect()}
    points = lambda d: sum(e.points for e in a[d].evidence)
    assert [points(f"m{i}") for i in range(4)] == [22, 12, 4, 0]
    assert points("m4") == 10 + 4 * 2 and points("m5") == 40 and points("m6") == 30
    assert a["m3"].health == 100.0 and a["m3"].trend == "baseline" and a["m0"].health == round(100 * math.exp(-22 / 85), 1)


def test_stream_ingest_is_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(40).select(F.col("id"), (F.col("id") % 5).alias("failure")).repartition(4).write.parquet(src)
    rules = {"failure flag": F.col("failure").isin(0, 1)}
    for _ in range(2):  # the second run finds nothing new
        q = jobs.ingest(jobs.follow(spark, src, "id long, failure long", files_per_trigger=1), rules, str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 40 and out.where("accepted = 'true'").count() == 16 and out.where("accepted = 'false'").first().reason == "failure flag"


def test_preamble_of_a_file_in_many_splits(spark, tmp_path):
    lines = ["# made by x", "# Time zone: UTC", "# a, b", "# Date and time,x", *(f"2018-01-01 00:{k // 60 % 60:02d}:{k % 60:02d},{k}.5" for k in range(4000)), "", "# Date and time,x", "2018-01-02 00:00:00,"]
    (tmp_path / "A_1_2018.csv").write_text("\r\n".join(lines) + "\r\n")
    (tmp_path / "B_2_2019.csv").write_text("# Time zone: UTC\n# Date and time,x\n2019-01-01 00:00:00,7\n")
    (tmp_path / "empty_3_2019.csv").write_text("# Time zone: UTC\n# Date and time,x\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = readers.preamble_csv(spark, str(tmp_path / "*.csv"), "at string, x double")
        rows = readers.turbine_files(df).collect()
        assert spark.read.text(str(tmp_path / "A_1_2018.csv")).rdd.getNumPartitions() > 5
        (tmp_path / "late_4_2019.csv").write_text("\n".join(["# x"] * 70) + "\n# Time zone: UTC\n# Date and time,x\n2019-01-01 00:00:00,7\n")
        with pytest.raises(Exception, match="no UTC header"):
            readers.preamble_csv(spark, str(tmp_path / "*.csv"), "at string, x double").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.x for r in rows if r.site == "A" and r.x is not None) == [k + 0.5 for k in range(4000)]
    assert [(r.at, r.x) for r in rows if r.site == "B"] == [("2019-01-01 00:00:00", 7.0)] and len(rows) == 4002


def test_members_of_a_tar_are_partitions(spark, tmp_path):
    import tarfile

    import pyarrow as pa
    import pyarrow.parquet as pq

    def member(name, at, more=()):
        columns = {"timestamp": at, "fan0": pa.array([float(len(name))] * len(at)), **dict(more)}
        pq.write_table(pa.table(columns), tmp_path / "part.parquet", row_group_size=2)
        return name, (tmp_path / "part.parquet").read_bytes()

    def archive(path, *members):
        with tarfile.open(path, "w") as tar:
            for name, content in (("readme.txt", b"x"), *members):
                info = tarfile.TarInfo(name)
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))
        return str(path)

    utc = pa.array([dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), None], pa.timestamp("us", tz="UTC"))
    good = archive(tmp_path / "a.tar", member("n1/x.parquet", utc), member("n22/x.parquet", utc, [("other", pa.array([1, 2, 3]))]))
    schema = "member string, timestamp timestamp, fan0 double"
    df = readers.tar_parquet(spark, good, schema)
    assert df.rdd.getNumPartitions() == 2
    assert sorted((r.member, r.timestamp is None, r.fan0) for r in df.collect()) == sorted((n, k == 2, float(len(n))) for n in ("n1/x.parquet", "n22/x.parquet") for k in range(3))
    assert readers.tar_parquet(spark, good, schema, r"n1/.*").count() == 3
    for bad, said in ((archive(tmp_path / "b.tar", member("x.parquet", utc.cast(pa.timestamp("us")))), "UTC"), (archive(tmp_path / "c.tar", member("x.parquet", utc)), "no column fan1")):
        with pytest.raises(Exception, match=said):
            readers.tar_parquet(spark, bad, schema + (", fan1 double" if "column" in said else "")).collect()


def test_wide_devices(spark):
    rows = spark.createDataFrame([(1, 2.0, "ok", 3.0, "bad", 9.0)], "t int, `a_temp` double, `a_temp__qc` string, `b_flow_rate` double, `b_flow_rate__qc` string, other double")
    assert sorted(map(tuple, readers.wide_devices(rows, "t").collect())) == [(1, "a", "temp", 2.0, "ok"), (1, "b", "flow_rate", 3.0, "bad")]


def test_datasets_and_pins(spark, tmp_path):
    one = spark.range(3)
    writers.dataset(str(tmp_path / "d"), one, one, one.withColumnRenamed("id", "o"), one, one)
    back = writers.read_dataset(spark, str(tmp_path / "d"))
    assert set(back) == {"records", "channel_spec", "observations", "annotations", "tasks"} and back["observations"].columns == ["o"]
    assert readers.pinned(spark, "no.table", "1", str(tmp_path / "d/tasks")).count() == 3


def test_monthly_reports(spark, tmp_path):
    report = '{""device"": {""protocol"": ""NVMe""},\n ""nvme_smart_health_information_log"": {""temperature"": 310, ""media_errors"": 1, ""power_on_hours"": 2, ""percentage_used"": 3}}'.replace("310", "31")
    head, one = "ts,extra,device_uuid,invalid,report\n", "12345678-1234-1234-1234-123456789012"
    for month, line in (("202401", f'2024-01-05 00:00:00,x,{one},f,"{report}"\n2024-02-05 00:00:00,x,{one},f,"{report}"\n'), ("202402", f'2024-02-05 00:00:00,"a,b",{one},t,"{report}"\n2024-02-06 00:00:00,x,{one},f,"{report}"\n')):
        with zipfile.ZipFile(tmp_path / f"reports-{month}.zip", "w") as z:
            z.writestr(f"data/{month}.csv", head + line)
            z.writestr("readme.txt", "no table")
    paths = [str(tmp_path / f"reports-{m}.zip") for m in ("202401", "202402")]
    rows = readers.zip_reports(spark, ",".join(paths))
    got = sorted((r.month, r.ts, r.reason, r.temperature) for r in quality.report_rows(rows, F.col("month")).collect())
    assert got == [("2024-01", "2024-01-05 00:00:00", None, 31.0), ("2024-01", "2024-02-05 00:00:00", "month", 31.0), ("2024-02", "2024-02-05 00:00:00", "marked invalid", 31.0), ("2024-02", "2024-02-06 00:00:00", None, 31.0)]
    with zipfile.ZipFile(tmp_path / "reports-202403.zip", "w") as z:
        z.writestr("a.csv", head)
        z.writestr("b.csv", head)
    with pytest.raises(Exception, match="one CSV member"):
        readers.zip_reports(spark, str(tmp_path / "reports-202403.zip")).collect()
    (tmp_path / "unnamed.zip").write_bytes((tmp_path / "reports-202401.zip").read_bytes())
    with pytest.raises(Exception, match="no month in the name"):
        readers.zip_reports(spark, str(tmp_path / "unnamed.zip")).collect()


def test_files_against_a_catalogue(spark, tmp_path):
    data = {"a": b"x" * 25, "b": b"", "c": b"hello"}
    for n, x in data.items():
        (tmp_path / n).write_bytes(x)
    md5, sha = (lambda x: hashlib.md5(x).hexdigest()), (lambda x: hashlib.sha256(x).hexdigest())
    parts = lambda x, n: md5(b"".join(hashlib.md5(x[i : i + n]).digest() for i in range(0, max(1, len(x)), n))) + f"-{max(1, -(-len(x) // n))}"
    rows = [
        ("a", 25, f"multipart-md5:{parts(data['a'], 10)}", sha(data["a"]), 10, None), ("a", 25, f"multipart-md5:{parts(data['a'], 9)}", None, 10, "checksum"), ("a", 25, f"md5:{md5(data['a'])}", sha(b"other"), None, "sha256"),
        ("b", 0, f"md5:{md5(b'')}", None, None, "missing"), ("c", 5, f"sha256:{sha(b'hello')}", None, None, None), ("c", 6, f"sha256:{sha(b'hello')}", None, None, "size"), ("c", 5, f"sha1:{md5(b'')}", None, None, "declared checksum"),
        ("c", 5, None, None, None, "declared checksum"), ("c", 5, f"md5:{md5(b'hello')}", None, 0, "declared part size"), ("d", 5, f"md5:{md5(b'hello')}", None, None, "missing"),
    ]
    declared = spark.createDataFrame(rows, "name string, bytes long, checksum string, sha256 string, part_bytes long, want string")
    got = readers.catalogue_faults(spark.read.format("binaryFile").load(str(tmp_path)), declared).collect()
    assert len(got) == len(rows) and [(r.name, r.reason) for r in got if r.reason != r.want] == []


def test_runs_of_a_device(spark, tmp_path):
    runs = readers.demo_fleet(spark, devices=3, days=4)
    writers.save_runs(runs.orderBy(F.desc("collected_at")), str(tmp_path / "runs"))
    got = readers.device_runs(spark, str(tmp_path / "runs"), "server-001").collect()
    assert len(got) == 4 and [r.collected_at for r in got] == sorted(r.collected_at for r in got) and {r.machine.id for r in got} == {"server-001"}
    demo = spark.createDataFrame([("server-001",), ("only-demo",)], "id string")
    known = {r.device: r.stored for r in readers.device_ids(spark, str(tmp_path / "runs"), demo).collect()}
    assert known == {"server-000": True, "server-001": True, "server-002": True, "only-demo": False}
