import difflib
import hashlib
import io
import itertools
import random
import re
import string
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import boxes, text
from tessera.operators import caption_qa, curation, vocabulary
from tessera.plans import bindings, registry
from tessera.sources import shards


def slow_greedy(classes, freq, target, size, cap):
    count, picked = np.zeros(len(freq), int), []

    def gain(own):
        if not own or any(count[c] >= cap for c in own):
            return None
        return sum((target[c] - count[c]) / max(1, target[c]) + 1 / max(1, freq[c]) if count[c] < target[c] else -0.5 for c in own) / len(own)

    while len(picked) < size:
        options = [(-g, i) for i, own in enumerate(classes) if i not in picked and (g := gain(own)) is not None]
        if not options:
            break
        i = min(options)[1]
        picked.append(i)
        for c in classes[i]:
            count[c] += 1
    return picked


def test_greedy_equals_brute_force():
    r = random.Random(0)
    for _ in range(100):
        k = r.randint(1, 8)
        classes = [[r.randrange(k) for _ in range(r.randint(0, 5))] for _ in range(r.randint(1, 40))]
        freq, target = np.array([r.randint(1, 9) for _ in range(k)]), np.array([r.randint(1, 4) for _ in range(k)])
        size, cap = r.randint(0, 30), r.randint(1, 6)
        assert curation.greedy(classes, freq, target, size, cap) == slow_greedy(classes, freq, target, size, cap)


def test_sub_batch_sizes(spark):
    got = spark.createDataFrame([(5120, 0.8), (100, 0.8), (24, 0.5)], "n int, r double").select(*[curation.sub_batch_size(__import__("pyspark").sql.functions.col("n"), x).alias(f"s{i}") for i, x in enumerate((0.8, 0.5))]).collect()
    assert [r.s0 for r in got[:2]] == [1024, 16] and got[2].s1 == 16


def test_concept_neighbours_of_every_super_batch(spark, sf):
    samples = [(r.sb, r.idx, set(r.classes)) for r in bindings.samples(spark, sf).collect()]
    want = {(s, i, n) for s, i, own in samples if (n := sum(s == t and i != j and bool(own & other) for t, j, other in samples))}
    assert {s for s, _, _ in want} == {0, 1, 2}
    assert {(r.sb, r.idx, r.neighbours) for r in registry.QUERIES["concept_neighbours"](spark, sf).collect()} == want
    own = spark.createDataFrame([(7, 0, ["a", "a"]), (7, 1, ["b"]), (7, 2, ["b", "a"]), (7, 3, []), (8, 0, ["a"])], "sb long, idx long, classes array<string>")
    assert {tuple(r) for r in curation.concept_neighbours(own).collect()} == {(7, 0, 1), (7, 1, 1), (7, 2, 2)}


def brute_check(caption, classes, strategy="vanilla", threshold=0.85, synonyms=lambda w: ()):
    """[(class, found, score)] by loops over all forms and words."""

    def forms(word):
        word = word.replace("-", " ").lower()
        bases = {word, text.lower_singular(word)}
        if strategy != "vanilla":
            bases |= {s for w in bases | set(word.split()) for s in synonyms(w)}
        out = set(bases)
        for w in bases:
            out |= {w + "ing", w[:-1] + "ing" if w.endswith("e") else w, w[:-1] + "ies" if w.endswith("y") else w + "es" if w.endswith(("s", "sh", "ch", "x", "z")) else w + "s"}
        return out

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = list(itertools.accumulate(enumerate(b), lambda last, jy: min(last + 1, row[jy[0] + 1] + 1, row[jy[0]] + (x != jy[1])), initial=i))
        return row[-1]

    t = re.sub(r"\s+-\s+", " ", re.sub(r"[^\w\s-]", "", (caption or "").lower()))
    said = set().union(*map(forms, t.split())) if t.split() else set()
    out = []
    for c in classes:
        own, score = forms(c.replace("-", " ")), 0.0
        if any(f in t or f in said for f in own):
            score = 1.0
        elif strategy == "full":
            best = max((1 - distance(f, w) / max(len(f), len(w)) for f in own for w in t.split()), default=0.0)
            score = best if best >= threshold else 0.0
        out.append((c.replace("-", " "), score > 0, round(score, 6)))
    return out


def test_captions_are_checked_for_their_classes(spark, sf):
    said = [("a dog don't run - fast", ["dogs", "dont", "don't", "run fast", "cats"]), ("Les Étés: baking CITIES; a fire-truck", ["étés", "bake", "city", "fire-truck", "ox"]), (None, ["a"]), ("", []), ("x", None)]
    said += [("photographic eqipment, hair dryers and worthles churhces", ["equipments", "photography", "hair drier", "worthless", "church", "hcruhc"]), ("a cat and categories", ["cat", "category", "kitten"])]
    d = spark.createDataFrame([(k, *r) for k, r in enumerate(said)], "doc_id long, text string, classes array<string>")
    assert caption_qa.forms_of("dogs", caption_qa.Language(), False) >= {"dogs", "dog", "dogging"[:3] + "ing"}
    for strategy in caption_qa.STRATEGIES:
        language = caption_qa.Language(synonyms=lambda w: ("cat",) if w == "kitten" else (w[::-1],))
        got = {r.doc_id: r for r in caption_qa.check(d, strategy, language=language).collect()}
        for k, (caption, classes) in enumerate(said):
            want = brute_check(caption, classes or [], strategy, synonyms=language.synonyms)
            assert [(x["class"], x.found, round(x.score, 6)) for x in got[k].details] == want, (strategy, k)
            assert got[k].all_found == all(f for _, f, _ in want)
    assert caption_qa.check(d.limit(0)).count() == 0
    [s] = caption_qa.summary(caption_qa.check(d)).collect()
    flat = [f for c, cl in said for _, f, _ in brute_check(c, cl or [])]
    assert (s.images, s.instances, s.missing) == (len(said), len(flat), flat.count(False)) and s.success == round(100 * flat.count(True) / len(flat), 6)
    [s] = caption_qa.summary(caption_qa.check(d.limit(0))).collect()
    assert (s.images, s.instances, s.missing, s.images_with_miss, s.success) == (0, 0, 0, 0, 0.0)
    rates = {r.strategy: (r.images, r.rate) for r in caption_qa.strategy_rates(d).collect()}
    assert set(rates) == set(caption_qa.STRATEGIES) and {n for n, _ in rates.values()} == {len(said)}

    rows_ = [(r.doc_id, r.text, r.classes) for r in bindings.captions(spark, sf).collect()]
    got = {(r.doc_id, r.idx): (r["class"], r.found, r.score) for r in registry.QUERIES["class_in_caption_full"](spark, sf).collect()}
    for i, caption, classes in rows_[:3]:
        for k, want in enumerate(brute_check(caption, classes, "full", synonyms=registry.synonyms_of)):
            assert got[i, k] == want
    assert len(got) == sum(len(c) for _, _, c in rows_)


def test_words_are_compared_with_few_forms():
    import random

    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdé") for _ in range(draw.randint(1, 24)))

    def changed(w):
        for _ in range(draw.randint(0, 4)):
            k = draw.randint(0, len(w))
            w = draw.choice((w[:k] + draw.choice("abx") + w[k:], w[:k] + w[k + 1 :], w[:k] + "z" + w[k + 1 :]))
        return w or "a"

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    forms = [word() for _ in range(80)]
    words = [word() for _ in range(40)] + [changed(f) for f in forms * 3]
    for threshold in (0.85, 0.7, 0.4, 0.0):
        index = caption_qa._Index({"one": set(forms[:50]), "two": set(forms[30:])}, threshold)
        for w in words[:: 1 if threshold > 0.5 else 9]:
            want = {(d / max(len(f), len(w)), f) for f in set(forms) if (d := edits(f, w)) <= int((1 - threshold) * max(len(f), len(w)) + 1e-9)}
            assert set(index.like(w)) == want

    counted, distance = [], caption_qa._distance
    try:
        caption_qa._distance = lambda a, b, most: counted.append(a) or distance(a, b, most)
        matches = caption_qa._Matches("full", 0.85, caption_qa.Language())
        names = [f"{x}{y}ation" for x in ("modern", "urban", "local", "organ", "author") for y in ("is", "iz", "ific", "ul", "er")]
        matches.add(set(names))
        said = " ".join(f"{w}{k}" for k in range(100) for w in ("organisatoin", "landscape", "qwertyuiop"))
        assert [x[:2] for x in matches.judge(said, names)] == [x[:2] for x in matches.judge(said, names)]
    finally:
        caption_qa._distance = distance
    assert len(counted) < 0.05 * len(said.split()) * len(names) * 5


def test_caption_normalisation(spark):
    d = spark.createDataFrame([("Don't stop - a hot-dog, été_1!",)], "t string")
    row = d.select(caption_qa.normalised(F.col("t")).alias("n"), vocabulary.single_spaced(F.lit(" hot-dog\t\n x\u00a0")).alias("s"), vocabulary.morphological(F.lit("red  buses boxes ladies glass gases bus")).alias("m")).first()
    assert row.n == "dont stop a hot-dog été_1" and row.s == "hot-dog x" and row.m == "red bus box lady glass gas bus"
    words = ["buses", "boxes", "ladies", "glass", "gases", "dogs", "ties", "is", "us", "été", "étés", "s", "churches", "hot dogs"]
    w = spark.createDataFrame([(x,) for x in words], "w string")
    assert [r[0] for r in w.select(text.singular(F.col("w"))).collect()] == [text.lower_singular(x) for x in words]


def plain_trim(t):
    if t.count(".") > 1 and not t.strip().endswith("."):
        return "".join(re.findall(r"[^.]*\.", t)).strip()
    return t.strip()


def plain_space(t):
    t = re.sub(text.EMOJI, "", t or "").replace("  ", " ")
    t = re.sub(rf"\s+([{text.MARKS}])", r"\1", t)
    return re.sub(rf"([{text.MARKS}])([^\s{text.MARKS}])", r"\1 \2", t).strip()


def plain_caption(t):
    t = re.sub(r"\s{2,}", " ", re.sub(r"""[.!"()*#:;~]""", " ", t.lower()))
    return " ".join(t.rstrip("\n").strip(" ").split(" ")[:30])


def plain_question(t):
    return " ".join(re.sub(r"""[.!"()*#:;~]""", "", t.lower()).rstrip(" ").split(" ")[:50])


def plain_canonical(t):
    return " ".join(t.replace("_", " ").translate(str.maketrans("", "", string.punctuation)).lower().split())


def test_text_queries_take_all_documents(spark, sf, tmp_path):
    odd = [None, "", "École fermée\xa0! Où\u202f?Là.Été. Ñandú", "\u3000Straße\u2003\xa0Ünder\x85x_y\u2028z .\u3000", "Señor.  ¿Qué?\xa0\xa0sí.\n", "ÀÉ «ça»…\u200a\u200aÇa, va😀 bien\n", "plain_text  here .", "\xa0"]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plain = {"trim_caption": plain_trim, "space_caption": plain_space, "pre_caption": plain_caption, "pre_question": plain_question, "canonicalize_text": plain_canonical, "whitespace_clean": lambda t: " ".join(t.split())}
    for folder in (str(tmp_path), sf):
        texts = [(r.doc_id, r.text) for r in bindings.table(spark, folder, "documents").collect()]
        assert not all(t and t.isascii() for _, t in texts)
        for name, f in plain.items():
            hashed = name not in ("pre_caption", "pre_question")
            want = {i: None if t is None and name != "space_caption" else hashlib.sha256(f(t).encode()).hexdigest() if hashed else f(t) for i, t in texts}
            assert {r[0]: r[1] for r in registry.QUERIES[name](spark, folder).collect()} == want, name


def test_text_quirks(spark):
    d = spark.createDataFrame([("The image shows apples. One. Two",)], "t string")
    row = d.select(text.clean_and_capitalize(F.col("t")).alias("c"), text.trim_caption(F.col("t")).alias("t"), text.preprocess_caption(F.lit("a ,,b 3.5!! é (x)) 🤖-y 中")).alias("p")).first()
    assert row.c.startswith("Pples") and row.t == "The image shows apples. One." and row.p == "a, b 3. 5! é( x)- y"
    people, both, prompt = d.select(
        text.clean_and_capitalize(F.lit("The image shows people")), text.clean_and_capitalize(F.lit("a\nassistant\nb\nassistant\nthe image\u00a0is an x\n")), text.build_prompt(F.lit("c" * 90), F.array(F.lit("a"), F.lit("b")))
    ).first()
    assert people == "The image shows people" and both == "X\n" and prompt == f"{text.PROMPT} Alt-text: {'c' * 77}. Classes: a, b."
    trimmed, cleaned = d.select(text.trim_caption(F.lit("One.\n")), text.clean("lower")(F.lit(" A &amp;amp; B\u00a0\n c "))).first()
    assert trimmed == "One." and cleaned == "a & b c"
    with pytest.raises(ValueError):
        text.clean("none")


def test_suppression_and_fusion(spark):
    schema = "image_id long, idx long, x1 double, y1 double, x2 double, y2 double, score double, label string, scale int"
    d = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0, 0.9, "a", 0), (1, 2, 0.0, 0.0, 1.0, 0.98, 0.8, "a", 0), (1, 3, 2.0, 2.0, 3.0, 3.0, 0.7, "b", 0), (1, 4, 0.0, 0.0, 1.0, 1.0, 0.2, "a", 0)], schema)
    assert [r.idx for r in boxes.suppress(d, ["image_id", "scale"]).orderBy("idx").collect()] == [1, 3]
    fused = {r.label: r for r in boxes.fuse(d).collect()}
    assert fused["a"].n_boxes == 2 and abs(fused["a"].score - 0.85 * 2 / 4) < 1e-9 and abs(fused["b"].score - 0.7 / 4) < 1e-9


def test_spelling_variants_equal_all_pairs(spark, sf):
    def brute(names):
        alike = lambda a, b: len(a) > 4 and len(b) > 4 and difflib.SequenceMatcher(None, a, b).ratio() > 0.92
        return {(i, j) for i, a in names for j, b in names if i < j and alike(a.lower(), b.lower())}

    r = random.Random(3)
    names = ["cold anvil", "old anvil", "esquire", "squire", "Xhotographic film", "photographic film", "hair drier", "hair dryer", "same name", "Same Name", "abcd", "bcd", "été éternel", "eté éternel"]
    for _ in range(60):
        name = "".join(r.choices("abc de", k=r.randint(6, 60)))
        names.append(name)
        for _ in range(4):
            other = list(name)
            for _ in range(r.randint(1, 5)):
                at = r.choice([0, 0, len(other) - 1, r.randrange(len(other))])
                other[at : at + r.randint(0, 1)] = r.choices("abcxyz", k=r.randint(0, 2))
                other = other or ["a"]
            names.append("".join(other))
    r.shuffle(names)
    names = list(enumerate(names))
    made = spark.createDataFrame(names, "ord long, concept string")
    want = brute(names)
    assert len(want) > 100
    assert {(p.earlier, p.later) for p in vocabulary.variant_pairs(made).where("kind = 'spelling'").collect()} == want

    # the queries, and leaders one by one over their pairs
    parts = [(c.ord, c.concept) for c in registry.variants_planted(spark, sf).collect()]
    pairs = {(p.earlier, p.later) for p in registry.QUERIES["vocab_variants"](spark, sf).collect()}
    assert {(p.earlier, p.later) for p in registry.QUERIES["vocab_variants"](spark, sf).where("kind = 'spelling'").collect()} == brute(parts)
    kept, leader = [], {}
    for i, _ in sorted(parts):
        leader[i] = next((k for k in kept if (k, i) in pairs), i)
        if leader[i] == i:
            kept.append(i)
    assert {x.ord: x.leader for x in registry.QUERIES["vocab_leader_merge"](spark, sf).collect()} == leader


def test_leaders_are_not_a_closure(spark):
    c = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "ord long, concept string")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "earlier long, later long")
    assert {r.ord: r.leader for r in vocabulary.leaders(c, pairs).collect()} == {1: 1, 2: 1, 3: 3}


def test_braces_and_weights(spark):
    assert shards.braces("s/{00..02}.{a,b}") == [f"s/0{i}.{x}" for i in range(3) for x in "ab"]
    with pytest.raises(ValueError):
        shards.expand_urls(spark, "a::b", "1")


def test_tars(spark, tmp_path):
    def tar(names):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            for n in names:
                info = tarfile.TarInfo(n)
                info.size = 600
                t.addfile(info, io.BytesIO(n[:1].encode() * 600))
        return out.getvalue()

    whole = tar(["1.JPG", "1.txt", "2.jpg", "2.jpg", "2.json"])
    assert [(k, sorted(m)) for k, m in shards.tar_samples(whole)] == [("1", ["jpg", "txt"]), ("2", ["jpg"]), ("2", ["jpg", "json"])]
    assert [k for k, _ in shards.tar_samples(whole[:2700])] == ["1"]
    assert list(shards.tar_samples(b"no tar")) == []
    (tmp_path / "00000.tar").write_bytes(whole)
    (tmp_path / "00001.tar").write_bytes(b"broken")
    assert shards.read_tars(spark, str(tmp_path)).count() == 3


def test_stream(spark, tmp_path):
    from tessera.streaming.curate import curate_stream

    spark.range(40).selectExpr("id AS idx", "array_repeat('x', cast(id % 5 AS int)) AS classes").coalesce(1).write.parquet(str(tmp_path / "in"))
    found = []
    stream = spark.readStream.schema("idx long, classes array<string>").parquet(str(tmp_path / "in"))
    curate_stream(stream, lambda rows, n: found.extend(rows.collect()), 20, str(tmp_path / "check")).awaitTermination(60)
    assert len(found) == 8 and {r.sb for r in found} == {0, 1}
