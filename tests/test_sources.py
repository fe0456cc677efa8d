import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import similarity, tagging, tokenize, vector
from tessera.operators import curation, vocabulary
from tessera.plans import bindings, registry
from tessera.sinks import writers
from tessera.sources import files, shards, tars


def tar(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, body in members:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("tars")
    big = bytes(5000)
    members = [("b.JPG", big), ("b.json", b'{"caption":"x","classes":["c"]}'), ("a.png", b"1"), ("a.json", b"{bad"), ("c.jpeg", b"2"), ("d.webp", b"3"), ("d.json", b"{}"), ("d.json", b'{"n":1}'), ("plain", b"4")]
    (path / "00000.tar").write_bytes(tar(members))
    (path / "00001.tar").write_bytes(b"broken")
    (path / "00002.tar").write_bytes(tar([("a.jpg", b"9"), ("b.jpg", big)])[:4000])
    (path / "00003.tar").write_bytes(tar([]))
    return str(path)


def test_tar_samples_member_by_member(spark, folder):
    rows = tars.read_samples(spark, folder).orderBy("shard", "ord").collect()
    assert [(r.shard[-9:], r.key, sorted(r.members)) for r in rows] == [("00000.tar", "b", ["jpg", "json"]), ("00000.tar", "a", ["json", "png"]), ("00000.tar", "c", ["jpeg"]), ("00000.tar", "d", ["json", "webp"]), ("00000.tar", "d", ["json"]), ("00002.tar", "a", ["jpg"])]
    lost = tars.read_samples(spark, folder, errors="keep").where("error IS NOT NULL").groupBy("shard").count().collect()
    assert sorted(r.shard[-9:] for r in lost) == ["00001.tar", "00002.tar"]
    one = tars.read_samples(spark, [f"{folder}/00000.tar", f"file://{folder}/00002.tar"], lower="false")
    assert one.where("map_contains_key(members, 'JPG')").count() == 1 and one.count() == 6
    assert tars.read_samples(spark, f"{folder}/absent").count() == 0


def test_tar_images_with_json(spark, folder):
    strict = tars.read_images(spark, folder).collect()
    assert [(r.name, len(r.image)) for r in strict] == [("b.JPG", 5000)]
    kept = tars.read_images(spark, folder, json="permissive").orderBy("shard", "ord").collect()
    assert [(r.shard[-6:-4], r.name, r.json) for r in kept] == [("00", "a.png", "{}"), ("00", "b.JPG", '{"caption":"x","classes":["c"]}'), ("00", "c.jpeg", "{}"), ("02", "a.jpg", "{}")]
    assert {r.name for r in tars.read_images(spark, folder, json="none", extensions=("webp",)).collect()} == {"d.webp"}
    failed = tars.read_images(spark, folder, errors="keep").where("error IS NOT NULL").collect()
    assert {(r.shard[-6:-4], r.name) for r in failed} >= {("00", "a.png"), ("00", "c.jpeg"), ("01", None), ("02", "a.jpg")}
    caption = {r.name: (r.caption, r.classes) for r in tars.caption_rows(spark.createDataFrame(kept, tars.IMAGES)).collect()}
    assert caption == {"b.JPG": ("x", ["c"]), "a.png": (None, []), "c.jpeg": (None, []), "a.jpg": (None, [])}
    counts = {r.shard[-6:-4]: r.files for r in tars.member_counts([f"{folder}/0000{k}.tar" for k in range(4)], spark).collect()}
    assert counts == {"00": 9, "01": 0, "02": 1, "03": 0}


def test_text_files(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("filepath\ttitle\tmore\na.jpg\tone\t1\nb.jpg\t\t2\n")
    assert [tuple(r) for r in files.open_source(spark, str(tmp_path / "p.tsv")).collect()] == [("a.jpg", "one"), ("b.jpg", None)]
    meta = tmp_path / "meta"
    meta.mkdir()
    (meta / "b.json").write_text('{"classes": ["x", "y"],\n "other": 1}')
    (meta / "a.json").write_text("{}")
    (meta / "c.txt").write_text("no")
    assert {r.filename: r.classes for r in files.json_folder(spark, str(meta)).collect()} == {"a.jpg": [], "b.jpg": ["x", "y"]}
    (meta / "d.json").write_text("{bad")
    assert files.json_folder(spark, str(meta), strict=False).count() == 3
    with pytest.raises(Exception, match="malformed"):
        files.json_folder(spark, str(meta)).collect()
    (tmp_path / "c.json").write_text(json.dumps({"a.jpg": "one", "b.jpg": "two"}))
    assert {tuple(r) for r in files.caption_map(spark, str(tmp_path / "c.json")).collect()} == {("a.jpg", "one"), ("b.jpg", "two")}
    (tmp_path / "v.json").write_text(json.dumps([{"a": ["1"]}, {"b": ["2"], "c": []}, {"a": ["3"]}]))
    assert [(r.concept, r.value) for r in files.vocabulary_file(spark, str(tmp_path / "v.json")).orderBy("ord", "sub").collect()] == [("a", ["3"]), ("b", ["2"]), ("c", [])]
    (tmp_path / "tags.txt").write_text("cat\ndog \n\nox\n")
    (tmp_path / "thr.txt").write_text("0.5\nnone\n0.7")
    got = files.tag_table(files.numbered_lines(spark, str(tmp_path / "tags.txt")), files.numbered_lines(spark, str(tmp_path / "thr.txt"))).orderBy("k").collect()
    assert [(r.k, r.tag, r.threshold) for r in got] == [(0, "cat", 0.5), (1, "dog ", 0.68), (2, "", 0.7), (3, "ox", 0.68)]
    with pytest.raises(ValueError):
        files.open_source(spark, "x.unknown")
    assert set(files.splits(spark, train={"path": str(tmp_path / "p.tsv")}, val=None, dummy={"path": "", "kind": "synthetic", "rows": 3})) == {"train", "dummy"}


def test_annotations(spark, tmp_path):
    rows = [{"image_path": f"{k}.jpg", "caption": ["a", "b", "c"], "union_label_id": [0, 2], "parse_label_id": [[0], [1], [2]]} for k in range(20)]
    (tmp_path / "1.json").write_text(json.dumps(rows))
    (tmp_path / "2.json").write_text(json.dumps([{"image_path": "x", "caption": [], "union_label_id": None, "parse_label_id": []}]))
    paths = [str(tmp_path / "1.json"), str(tmp_path / "2.json")]
    got = files.annotation_files(spark, paths, 3).collect()
    assert len(got) == 21 and {r.text for r in got} == {"a", "b", "c", None}
    assert all(r.image_tags == [1, 0, 1] and r.text_tags["abc".index(r.text)] == 1 and sum(r.text_tags) == 1 for r in got if r.text)
    assert {tuple(r.image_tags) for r in got if not r.text} == {(0, 0, 0)}
    assert [r.text for r in got] == [r.text for r in files.annotation_files(spark, paths, 3).collect()] != [r.text for r in files.annotation_files(spark, paths, 3, epoch=1).collect()]


def test_class_folders_and_cache(spark, tmp_path):
    for name in ("n2", "n1"):
        (tmp_path / "images" / name).mkdir(parents=True)
        (tmp_path / "images" / name / "a.jpg").write_bytes(name.encode())
    assert {(r.name, r.class_id) for r in files.class_folders(spark, str(tmp_path / "images")).collect()} == {("n1", 0), ("n2", 1)}
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    path = str(tmp_path / "cache")
    assert [files.cached(spark, path, build).count() for _ in range(2)] == [3, 3] and len(made) == 1
    urls = spark.createDataFrame([("s/a.jpg",), ("s/b.jpg",)], "url string")
    assert [r.url for r in files.existing(spark, urls, str(tmp_path / "images" / "n1")).collect()] == ["s/a.jpg"]


def test_shard_columns(spark):
    d = spark.createDataFrame([(1, {"png": "p", "webp": "w"}, "X.JPG"), (2, {}, "y.webp"), (3, None, "z")], "k int, m map<string,string>, name string")
    got = d.select(shards.first_present("m").alias("i"), shards.is_image(F.col("name")).alias("x")).collect()
    assert [tuple(r) for r in got] == [("p", True), (None, False), (None, False)]
    assert shards.complete(d, "m").count() == 2 and shards.map_columns(d, name=F.lower).first()["name"] == "x.jpg"
    images = spark.createDataFrame([("a.b.jpg",), ("c.png",)], "name string")
    texts = spark.createDataFrame([("a.b.json", "{1}")], "name string, json string")
    assert [tuple(r) for r in shards.with_sidecar(images, texts).collect()] == [("a.b.jpg", "{1}")]
    assert {tuple(r) for r in shards.with_sidecar(images, texts, keep=True).collect()} == {("a.b.jpg", "{1}"), ("c.png", "{}")}


def test_writers(spark, tmp_path):
    samples = spark.createDataFrame([("d/a.jpg", [1.5, 2.0], "x", None), ("b.png", [], "é", 3)], "filename string, boxes array<double>, caption string, n int")
    written = writers.write_samples(samples, str(tmp_path / "json"))
    assert {r.file for r in written.collect()} == {"a.json", "b.json"}
    text = (tmp_path / "json" / "a.json").read_text()
    assert json.loads(text) == {"boxes": [1.5, 2.0], "caption": "x", "n": None} and '    "boxes": [1.5, 2.0],\n' in text
    assert json.loads((tmp_path / "json" / "b.json").read_text())["caption"] == "é" and len(list((tmp_path / "json").iterdir())) == 2
    rows = spark.createDataFrame([("0", "a", 1, "old"), ("0", "a", 2, "new"), ("1", "b", 1, "x")], "shard string, filename string, at int, caption string")
    writers.write_by_shard(rows, str(tmp_path / "caps"), order="at")
    writers.write_by_shard(rows.where("shard = '1'").withColumn("caption", F.lit("y")), str(tmp_path / "caps"))
    assert {(r.filename, r.caption) for r in spark.read.parquet(str(tmp_path / "caps")).collect()} == {("a", "new"), ("b", "y")}
    entries = spark.createDataFrame([(2, "b", []), (1, "a", ["x"])], "ord int, concept string, value array<string>")
    for n, want in ((2, [{"a": ["x"]}, {"b": []}]), (1, [{"b": []}]), (0, [])):
        writers.write_vocabulary(entries.limit(n) if n else entries.where("false"), str(tmp_path / "voc"))
        [part] = [p for p in (tmp_path / "voc").iterdir() if p.name.startswith("part")]
        assert json.loads(part.read_text()) == want
    for k in range(2):
        writers.append_result(spark, str(tmp_path / "results"), epoch=k, top1=0.5)
    assert {(r.epoch, r.top1) for r in writers.read_results(spark, str(tmp_path / "results")).collect()} == {(0, 0.5), (1, 0.5)}
    ranked = spark.createDataFrame([(1, 0, "a"), (0, 1, "b"), (0, 0, "a"), (1, 1, "c")], "rank int, pos int, id string")
    assert [(r.id, r.rank, r.place) for r in writers.save_result(ranked, str(tmp_path / "ranks"), key="id").orderBy("place").collect()] == [("a", 0, 0), ("b", 0, 1), ("c", 1, 2)]
    assert writers.save_result(ranked, str(tmp_path / "ranks")).count() == 4
    assert writers.scalars(spark.createDataFrame([(1, 2, 0.5)], "step int, n int, loss double"), "step", ["n", "loss"]).count() == 2


def test_token_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    coder, texts = Tokenizer.from_file(path), ["a cat sat", None, "", " ".join(f"word{k} noun" for k in range(60))]
    plain = [coder.encode(t or "", add_special_tokens=False).ids for t in texts]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    rank = lambda w: 1 if w == "noun" else 4
    for kind in tokenize.REDUCTIONS:
        got = [r.ids for r in tokenize.token_ids(d, path, 1, 2, reduction=kind, context=30, seed=5, priority=rank).orderBy("k").collect()]
        assert got == [r.ids for r in tokenize.token_ids(d, path, 1, 2, reduction=kind, context=30, seed=5, priority=rank).orderBy("k").collect()]
        for ids, own in zip(got[:3], plain[:3], strict=True):
            assert ids == [1, *own, 2, *[0] * (28 - len(own))]
        kept = got[3][1:-1]
        assert len(got[3]) == 30 and got[3][0] == 1 and got[3][-1] == 2
        if kind == "cut":
            assert kept == plain[3][:28]
        if kind == "simple":
            assert any(kept == plain[3][k : k + 28] for k in range(len(plain[3])))
        if kind == "random":
            at = iter(plain[3])
            assert all(x in at for x in kept)
        if kind == "syntax":
            assert coder.decode(kept).split() == ["noun"] * len(coder.decode(kept).split())
    back = tokenize.texts_of(tokenize.token_ids(d, path, 1, 2), path, special=(0, 1, 2)).orderBy("k").collect()
    assert back[0].text == "a cat sat"


def test_reductions_share_one_pass_over_slices_of_the_texts(spark, sf):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tessera.plans import evaluation

    path = public_tokenizers.path("byte_bpe_50k.json")
    plan = evaluation.token_reduction(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    texts = [None if k % 13 == 5 else " ".join(f"{k}é word{j % (k + 9)}" for j in range(k * 160)) for k in range(40)]
    texts[3], texts[9] = "<|endoftext|>", texts[9] + " <|endoftext|>tail  of it\u2003 \n"
    texts[17], texts[30] = "long " * (tokenize.CHUNK // 4), "very long " * (tokenize.CHUNK // 9)
    slices = list(tokenize._slices(pa.array(texts)))
    assert [t for x in slices for t in x] == [t or "" for t in texts] and len(slices) > 2
    assert all(len(x) == 1 or sum(len(t.encode()) for t in x) <= tokenize.CHUNK + max(len(t.encode()) for t in x) for x in slices)
    kinds = dict(zip("abcdef", (*tokenize.REDUCTIONS, "syntax"), strict=True))
    d = spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1)
    got = tokenize.reduced_ids(d, path, 1, 2, kinds, context=30, seed=5, priority=len).orderBy("k").collect()
    coder = Tokenizer.from_file(path)
    for r, t in zip(got, texts, strict=True):
        t = t or ""
        for name, kind in kinds.items():
            own = " ".join(tokenize.prioritised(t.split(), 28, len)) if kind == "syntax" else t
            ids = tokenize.fitted(np.array(coder.encode(own, add_special_tokens=False).ids, int), 28, kind, tokenize.xxhash.xxh3_64_intdigest(t, seed=5)).tolist()
            assert r[name] == [1, *ids, 2, *[0] * (28 - len(ids))]
    with pytest.raises(ValueError):
        tokenize.token_ids(d, path, 1, 2, reduction="none")


def test_vectors(spark):
    r = np.random.default_rng(0)
    x, y = r.normal(size=(2, 150, 8))
    frame = lambda a: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "id long, v array<double>")
    s = x @ y.T
    want = {("image_to_text", i): int((s[i] > s[i, i]).sum()) for i in range(150)} | {("text_to_image", i): int((s[:, i] > s[i, i]).sum()) for i in range(150)}
    small, similarity.BLOCK = similarity.BLOCK, 40
    try:
        similarity.blocks.__defaults__ = (40,)
        assert {(q.direction, q.id): q.place for q in similarity.true_ranks(frame(x), frame(y), "id", "v").collect()} == want
    finally:
        similarity.BLOCK = small
        similarity.blocks.__defaults__ = (small,)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T
    assert {(p.a, p.b) for p in similarity.similar_pairs(frame(x), "id", "v", 0.6).collect()} == {(i, j) for i in range(150) for j in range(i + 1, 150) if near[i, j] > 0.6}
    with pytest.raises(ValueError):
        vector.pooled(frame(x), ["id"], "other")


def test_tagging(spark):
    d = spark.createDataFrame([(1, "red cat", ["cat", "dog"]), (2, "tree", ["cat"]), (3, "a big dog", ["big", "dog"])], "k int, phrase string, candidates array<string>")
    assert {(r.k, r.label) for r in tagging.phrase_classes(d).collect()} == {(1, "cat"), (3, "big")}
    logits = spark.createDataFrame([(1, 0, 5.0), (1, 1, -5.0), (2, 0, -5.0), (2, 1, -6.0)], "id int, k int, logit double")
    tags = spark.createDataFrame([(0, "Cat", None), (1, "dog", 0.1)], "k int, tag string, threshold double")
    assert {r.id: r.tags for r in tagging.chosen_tags(logits, tags, "id").collect()} == {1: "Cat", 2: ""}
    assert {r.id: r.caption for r in tagging.tag_caption(logits, tags, "id", 0.5).collect()} == {1: "cat.", 2: "cat."}


def test_numbering_and_epochs(spark):
    rows = spark.createDataFrame([(k % 7 * 1.0, k) for k in range(1000)], "a double, b int")
    before, curation.NUMBERED = curation.NUMBERED, 100
    try:
        got = curation.numbered(rows, ["a", "b"]).orderBy("a", "b").collect()
    finally:
        curation.NUMBERED = before
    assert [r.number for r in got] == list(range(1000))
    assert curation.batches(rows, ["a", "b"], 64).count() == 960 and curation.batches(rows, ["a", "b"], 64, keep_partial=True).count() == 1000
    assert curation.epochs(curation.batches(rows, ["a", "b"], 10), 20, most=3).count() == 600
    order = [r.b for r in curation.shuffled(rows, "b", 1).collect()]
    assert sorted(order) == list(range(1000)) and order != sorted(order) and order == [r.b for r in curation.shuffled(rows.repartition(3), "b", 1).collect()]
    assert curation.worker_seed(3, 2, 8, 1) == 13 and curation.rank_seed(3, 2) == 5


def test_selection_equals_slow_selection(spark, sf):
    """The query's rows, rank by rank, against an arg-max over all rows at every step."""
    from tests.test_operators import slow_greedy

    samples = bindings.samples(spark, sf).collect()
    targets = {(r.sb, r.concept): r for r in registry._targets(spark, sf).collect()}
    got = {}
    for r in registry.QUERIES["cabs_dm_select"](spark, sf).orderBy("pick").collect():
        got.setdefault((r.sb, r["rank"]), []).append(r.idx)
    for sb in {r.sb for r in samples}:
        own = sorted((r.idx, r.classes) for r in samples if r.sb == sb)
        names = sorted(c for s, c in targets if s == sb)
        freq, target = (np.array([targets[sb, c][k] for c in names]) for k in ("freq", "target"))
        total = int(2 ** round(np.log2(0.2 * len(own))))
        for rank in range(4):
            part = [(i, c) for i, c in own if i % 4 == rank]
            size = total // 4 + (rank < total % 4)
            want = [part[k][0] for k in slow_greedy([[names.index(c) for c in cs] for _, cs in part], freq, target, size, 10)]
            assert got[sb, rank][: len(want)] == want
            free = {i for i, c in part if not c}
            assert len(got[sb, rank]) == min(size, len(want) + len(free)) and set(got[sb, rank][len(want) :]) <= free


def test_boxes_equal_slow_versions(spark, sf):
    from tessera.functions.boxes import _iou_one

    rows = bindings.boxes(spark, sf).collect()
    by = {}
    for r in rows:
        by.setdefault((r.image_id, r.scale), []).append(r)
    want = set()
    for own in by.values():
        kept = []
        for r in sorted(own, key=lambda r: (-r.score, r.idx)):
            if all(_iou_one((r.x1, r.y1, r.x2, r.y2), (k.x1, k.y1, k.x2, k.y2)) <= 0.9 for k in kept):
                kept.append(r)
        want |= {(r.image_id, r.idx) for r in kept}
    assert {(r.image_id, r.idx) for r in registry.QUERIES["box_nms"](spark, sf).collect()} == want
    groups = {}
    for r in rows:
        if r.score >= 0.26:
            groups.setdefault((r.image_id, r.label), []).append(r)
    fused = []
    for (image, label), own in groups.items():
        clusters = []
        for r in sorted(own, key=lambda r: (-r.score, r.idx)):
            box = np.array([r.x1, r.y1, r.x2, r.y2])
            overlaps = [_iou_one(c[0], box) for c in clusters]
            if overlaps and max(overlaps) > 0.3:
                c = clusters[int(np.argmax(overlaps))]
                c[1].append((box, r.score))
                c[0] = sum(b * s for b, s in c[1]) / sum(s for _, s in c[1])
            else:
                clusters.append([box, [(box, r.score)]])
        fused += [(image, label, *np.round(c[0], 6), round(np.mean([s for _, s in c[1]]) * min(len(c[1]), 4) / 4, 6)) for c in clusters]
    assert sorted((r.image_id, r.label, *(round(v, 6) for v in (r.x1, r.y1, r.x2, r.y2)), round(r.score, 6)) for r in registry.QUERIES["box_wbf"](spark, sf).collect()) == sorted(fused)


def test_vocabulary_cleanup(spark):
    names = ["Hot_Dog", "hot dog", "hot  dog", "hot dogs", "hd", "photographic film", "photographic filmm", "cat", "kitten", "bad word"]
    v = spark.createDataFrame([(k, n, [n]) for k, n in enumerate(names)], "ord long, concept string, value array<string>")
    e = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.99, 0.01]), (9, [0.0, 1.0])], "ord long, embedding array<double>")
    verdicts = spark.createDataFrame([("bad word", "UNSAFE_NSFW"), ("cat", "SAFE")], "concept string, verdict string")
    kept, counters = vocabulary.clean_concepts(v, e, verdicts)
    assert [(r.concept, r.value) for r in kept.orderBy("ord").collect()] == [("hot dog", ["Hot_Dog"]), ("photographic film", ["photographic film"]), ("cat", ["cat"])]
    assert {(r.stage, r.status): r.n for r in counters.collect()} == {("key", "merged"): 1, ("spacing", "merged"): 1, ("lemma", "merged"): 1, ("duplicate", "merged"): 3, ("safety", "UNSAFE_NSFW"): 1}
