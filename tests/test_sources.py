import base64
import gzip
import json

import pytest

from quillstream.sources import pools, readers, sinks


def test_manifest_and_metadata(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(["a.jpg", "b.jpg"]))
    (tmp_path / "meta.json").write_text(json.dumps({"input_size": 160, "accept": {"p": 0.6, "margin": 0.3}}, indent=1))
    assert {(r.cls, r.file) for r in readers.manifest(spark, str(tmp_path / "m.json")).collect()} == {(0, "a.jpg"), (1, "b.jpg"), (256, "start.png"), (257, "end.png")}
    assert readers.model_metadata(spark, str(tmp_path / "meta.json")).first().accept.p == 0.6


def test_labelled_folder_and_candidates(spark, tmp_path):
    for name in ("3/a.jpg", "12/b.jpg", "other/c.jpg", "3/d.txt"):
        p = tmp_path / "real" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    rows = readers.labelled_folder(spark, str(tmp_path / "real"), repeat=3).collect()
    assert sorted(r.cls for r in rows) == [3] * 3 + [12] * 3 and {r.turns for r in rows} <= {0, 1, 2, 3}
    (tmp_path / "new").mkdir()
    for name, data in (("7.jpg", b"x"), ("start.PNG", b"x"), ("300.jpg", b"x"), ("8.gif", b"x"), ("9.webp", b"")):
        (tmp_path / "new" / name).write_bytes(data)
    assert sorted(r.target for r in readers.candidates(spark, str(tmp_path / "new")).collect()) == [7, 256]


@pytest.mark.parametrize("stored,want", [('[{"id":"a","text":"hi","at":5},{"id":"b"}]', ["hi"]), ("{broken", []), ("", []), ('"text"', [])])
def test_stored_history(spark, tmp_path, stored, want):
    (tmp_path / "h.json").write_text(stored)
    assert [r.text for r in readers.stored_history(spark, str(tmp_path / "h.json")).collect()] == want


def test_fixtures_round_trip(spark, tmp_path):
    with gzip.open(tmp_path / "f.json.gz", "wt") as f:
        f.write(json.dumps({"width": 2, "rgb": base64.b64encode(b"\0\1\2").decode()}) + "\n")
    rows = readers.packed_fixtures(spark, str(tmp_path / "f.json.gz"))
    assert bytes(rows.first().rgb) == b"\0\1\2"
    sinks.write_fixtures(rows, str(tmp_path / "out"))
    assert bytes(readers.packed_fixtures(spark, str(tmp_path / "out")).first().rgb) == b"\0\1\2"


def test_every_nth(spark):
    rows = spark.createDataFrame([(k, k % 2) for k in range(20)], "t int, s int")
    assert sorted(r.t for r in readers.every_nth(rows, "t", 30, 10, "s").collect()) == [0, 1, 6, 7, 12, 13, 18, 19]


def test_label_mix(spark):
    n = 40_000
    seen = {r.label: r["count"] / n for r in pools.labels(spark, n, 7).groupBy("label").count().collect()}
    assert abs(seen[258] - 0.12) < 0.01 and abs(seen[256] - 0.05) < 0.01 and abs(seen[257] - 0.03) < 0.01 and len(seen) == 259
    focus = pools.labels(spark, n, 7, focus=(5, 9)).where("label IN (5, 9)").count() / n
    assert abs(focus - 0.3) < 0.02
    again = pools.labels(spark, 100, 7).collect()
    assert again == pools.labels(spark, 100, 7).repartition(7).orderBy("id").collect()


def test_pool_is_made_once(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or pools.labels(spark, 10, 1)
    for _ in range(3):
        assert pools.kept_pool(spark, str(tmp_path), {"n": 10, "seed": 1}, make).count() == 10
    assert len(made) == 1


def test_mixture_and_rejection(spark):
    synthetic = pools.labels(spark, 5000, 3)
    stored = spark.createDataFrame([(1000 + k,) for k in range(7)], "label int").repartition(3)
    mixed = pools.mixture(synthetic, stored, 0.25, 3)
    share = mixed.where("label >= 1000").count() / 5000
    assert mixed.count() == 5000 and abs(share - 0.25) < 0.03
    assert mixed.where("label >= 1000").select("label").distinct().count() == 7
    assert pools.mixture(synthetic, stored.where("false"), 0.5, 3).count() == 5000
    assert {r.label for r in pools.of_class(synthetic, 258, 50).collect()} == {258}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "5"), (2, "gap"), (3, None), (4, "x"), (5, "5")], "id int, label string")
    sinks.export_by_class(rows, str(tmp_path / "by"))
    assert {(r.id, r.cls) for r in spark.read.parquet(str(tmp_path / "by")).collect()} == {(1, 5), (5, 5), (2, 258)}
    for _ in range(2):
        sinks.append_metrics(rows.limit(1), str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).count() == 2
    sinks.write_log(rows, rows, str(tmp_path / "log"), version="2")
    assert spark.read.json(str(tmp_path / "log/about")).first().version == "2"
    assert sinks.write_history(rows, str(tmp_path / "history"))
    (tmp_path / "file").write_text("")
    assert not sinks.write_history(rows, str(tmp_path / "file/below"))
    lines = spark.createDataFrame([("replace", "| 1 |"), ("fine", "| 2 |")], "level string, line string")
    sinks.write_report(lines, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == 2


def test_ranking_and_manifest_are_read_again(spark, tmp_path):
    ranked = spark.createDataFrame([(1, 0.5, ["a"]), (2, 0.9, []), (3, 0.9, ["b", "c"])], "cls int, risk double, reasons array<string>")
    sinks.write_ranking(ranked, str(tmp_path / "r"))
    assert [(r.cls, r.risk, r.reasons) for r in readers.ranking(spark, str(tmp_path / "r")).collect()] == [(2, 0.9, []), (3, 0.9, ["b", "c"]), (1, 0.5, ["a"])]
    old, new = (spark.createDataFrame(x, "cls int, file string") for x in ([(1, "a"), (2, "b"), (3, "c")], [(2, "n"), (3, "c")]))
    changed = [(2, "b", "n")]
    assert [tuple(r) for r in sinks.rewrite_manifest(old, new, str(tmp_path / "m"), dry_run=True).collect()] == changed and not (tmp_path / "m").exists()
    assert [tuple(r) for r in sinks.rewrite_manifest(old, new, str(tmp_path / "m")).collect()] == changed
    assert sorted((r.cls, r.file) for r in spark.read.json(str(tmp_path / "m")).collect()) == [(1, "a"), (2, "n"), (3, "c")]
    sinks.write_truth(old, str(tmp_path / "t"), fps=30)
    assert spark.read.json(str(tmp_path / "t/frames")).count() == 3 and spark.read.json(str(tmp_path / "t/about")).first().fps == "30"


def test_images_of_the_classes_asked_for(spark, tmp_path):
    for n in "abc":
        (tmp_path / f"{n}.png").write_bytes(n.encode())
    manifest = spark.createDataFrame([(1, "a.png"), (2, "b.png"), (3, "c.png")], "cls int, file string")
    wanted = spark.createDataFrame([(2,), (2,), (3,), (9,)], "cls int")
    got = readers.class_images(spark, manifest, wanted, str(tmp_path)).collect()
    assert sorted((r.cls, r.file, bytes(r.content)) for r in got) == [(2, "b.png", b"b"), (3, "c.png", b"c")]
    assert readers.class_images(spark, manifest, wanted.where("cls = 9"), str(tmp_path)).count() == 0


def test_crops_as_tensors():
    import numpy as np

    from quillstream.operators.frames import tensor

    x = np.arange(2 * 4 * 5 * 3).reshape(2, 4, 5, 3).astype(np.uint8)
    t = tensor(x)
    assert t.shape == (2, 3, 4, 5) and t.dtype == np.float32 and abs(float(t[1, 2, 3, 4]) - x[1, 3, 4, 2] / 255) < 1e-6
