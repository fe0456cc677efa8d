import hashlib
import random
import textwrap
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import rows
from tessera.functions import bytewords
from tessera.llm import arrow_output, bagminhash, chat, common, exact_dedup, html_text, licences, media, mixing, near_dedup, packing, queries, tiff, tokens, toxicity
from tessera.llm.common import scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, mark string"
LONG = "word " * 60_000
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (5, "abc"), (6, "a b c"), (6, "a b c"), (6, "other"), (None, "x y"), (None, None), (9, LONG), (10, LONG + "!"), (11, "zażółć 中文 🙂 </s>[INST]")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, None if k % 3 == 0 else f"s{k % 3}", None, 7, "m") for k, (i, t) in enumerate(ODD)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(name, spark, sf, duck):
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(duck.sql(queries.ORACLES[name]).df())


def test_encoder_is_exact():
    coder, r = tokens.Encoder(), random.Random(0)
    parts = [" ", "  ", "\n", "\t", "\xa0", "\x85", "\x1c", "a", "B.", "é", "中", "'s", "1", "<|endoftext|>", "!?", ")", "​", " "]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(25))) for _ in range(3000)] + [None, ""]
    offsets, ids = coder.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert coder.tokenizer.encode(t or "", add_special_tokens=False).ids == ids[offsets[k] : offsets[k + 1]].tolist()


class _Counted:
    """A tokenizer that counts the bytes it encodes."""

    def __init__(self, own):
        self.own, self.bytes = own, 0

    def encode_batch_fast(self, texts, **more):
        self.bytes += sum(len(t.encode()) for t in texts)
        return self.own.encode_batch_fast(texts, **more)


def test_encoder_remembers_many_words():
    """Half a million words are known when they come again, alone or with other punctuation."""
    coder = tokens.Encoder()
    library = coder.tokenizer
    coder.tokenizer = _Counted(library)
    r = random.Random(2)
    names = ["".join(r.choices("abcdefghij", k=7)) for _ in range(500_000)]
    texts = pa.array([" ".join(names[k : k + 5_000]) for k in range(0, len(names), 5_000)])
    coder.encode(texts)
    before = coder.tokenizer.bytes
    offsets, ids = coder.encode(pa.array([f"z {t.as_py()}.!)" for t in texts]))
    assert coder.tokenizer.bytes - before < 100
    for k in (0, 50, 99):
        assert library.encode(f"z {texts[k].as_py()}.!)", add_special_tokens=False).ids == ids[offsets[k] : offsets[k + 1]].tolist()


def test_encoder_is_exact_over_calls(monkeypatch):
    """Words known from other calls, in another order and after forgetting."""
    monkeypatch.setattr(bytewords, "MEMO", 3_000)
    coder, r = tokens.Encoder(), random.Random(3)
    parts = [" ", " ", " ", "  ", "\n", "\u3000", "ab", "Cé", "½", "中", "'s", "12", ".", ",%", '!")', "-", "_"]
    for _ in range(60):
        texts = ["".join(r.choice(parts) for _ in range(r.randrange(20))) for _ in range(r.randrange(60))]
        offsets, ids = coder.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_exact_dedup(odd, empty):
    got = exact_dedup.dedup(odd, block=4).collect()
    assert len(got) == len(ODD) and exact_dedup.dedup(empty).count() == 0
    groups = defaultdict(list)
    for i, t in ODD:
        groups["".join((t or "").split())].append((i, len(t or "")))
    for r in got:
        own = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(own) and r.keep_id == min(own, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[0]
    assert sum(r.kept for r in got) == len(groups)


def test_names_follow_from_the_texts_alone(spark, odd):
    named = lambda d: sorted((r.text_sha256, r.levels, r.name) for r in exact_dedup.identities(d, block=4).collect())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = named(odd)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert named(odd.repartition(5, "text")) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    blocks = exact_dedup.block_names(odd, block=4).collect()
    assert sorted(r.name for r in blocks) == list(range(len(blocks)))


def test_histogram_packing_loses_nothing():
    r = random.Random(0)
    for _ in range(50):
        h = {r.randint(1, 64): r.randint(1, 500) for _ in range(r.randint(1, 30))}
        patterns = packing.pack_histogram(h, 64)
        used = Counter()
        for pack, n in patterns:
            assert sum(pack) <= 64
            for x in pack:
                used[x] += n
        assert used == Counter(h)


def test_packing(spark, odd, empty):
    pieces = packing.pieces(odd)
    placed = packing.place(pieces, ["id", "start", "length", "ids"]).toPandas()
    taken = defaultdict(int)
    for _, p in placed.sort_values(["sequence_id", "offset"]).iterrows():
        assert p.offset == taken[p.sequence_id]
        taken[p.sequence_id] += p.length
    assert max(taken.values()) <= 1024 and set(taken) == set(range(len(taken)))
    assert packing.pack(empty).count() == 0
    whole = packing.sequences(packing.place(pieces, ["id", "start", "length", "ids"])).toPandas()
    assert sum(int((s > 0).sum()) for s in whole.segments) == sum(taken.values())


def test_fit_meets_budgets():
    r = random.Random(0)
    for _ in range(200):
        lengths = np.array(sorted(r.sample(range(1, 40), r.randint(1, 8))))
        counts = np.array([r.randint(0, 5) for _ in lengths])
        budget = r.randint(0, int((lengths * counts).sum()) + 5)
        taken = mixing.fit(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all() and (taken * lengths).sum() <= max(budget, 0)
    assert (mixing.fit(np.array([3, 5]), np.array([10, 10]), 31) * [3, 5]).sum() == 31


def test_mixing(spark, odd, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and mixing.mix(empty).count() == 0
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.passes <= 3 and r.size == len((dict(ODD).get(r.id) or "").split()) or r.id in (6, None)
        by[r.source].append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes, total = {s: sum(r.size for r in by[s]) for s in names}, sum(r.size for r in got)
    weight, want, open_ = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}, {}, set(names)
    while True:
        left = total - sum(want.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            want |= share
            break
        want |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    for s in names:
        assert abs(by[s][0].target - want[s]) < 1e-6


def brute_groups(texts):
    bags = []
    for t in texts:
        w = (t or "").lower().split()
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both, total = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if (both / total if total else 1) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def test_near_dedup_equals_brute_force(spark, empty):
    r = random.Random(3)
    texts = []
    for _ in range(12):
        words = [f"w{r.randrange(400)}" for _ in range(r.randint(3, 150))]
        for _ in range(8):
            own = list(words)
            for _ in range(r.randint(0, 6)):
                own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(own[: r.choice([len(own), len(own), len(own) * 9 // 10])]))
    texts += [None, "", " ", "one", "One", "a b a b a b a b a b a b", "a b a b a b a b a b a b a b"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.id: x.group_id for x in near_dedup.groups(d).collect()}
    assert [got[i] for i in range(len(texts))] == brute_groups(texts)
    assert near_dedup.groups(empty).count() == 0


def test_near_dedup_odd_rows(odd):
    got = near_dedup.groups(odd).collect()
    assert len(got) == len(ODD)
    assert {r.group_id for r in got if r.id in (9, 10)} == {9} and {r.group_id for r in got if r.id in (1, 2, 3)} == {1}


def test_signatures_are_unbiased():
    r = np.random.default_rng(0)
    w, e = r.integers(0, 9, (2, 400)), r.integers(0, 2**63, 400).astype(np.uint64)
    keep = w.ravel() > 0
    s = bagminhash.signatures(np.repeat([0, 1], 400)[keep], np.tile(e, 2)[keep], w.ravel()[keep], 2, 8192)
    assert abs((s[0] == s[1]).mean() - np.minimum(*w).sum() / np.maximum(*w).sum()) < 0.02


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", r"<\/s> [\INST] [\\TEXT]", "[SEG", None, "", "x" * 50_000, "<s>[TURN]user[TEXT]"]
    data = [(c, t, "user" if t % 4 < 2 else "assistant", said[(c + t) % len(said)]) for c in range(5) for t in range(9)] + [(5, 0, None, "a"), (None, None, "[TURN]", "b"), (5, 0, None, "a")]
    d = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    for r in chat.read_back(chat.format_chats(d)).collect():
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in data if c == r.conv_id))
        assert [(x.role, x.text) for x in r.turns] == [(x[2], x[3]) for x in own]
        assert r.loss_text == "".join(x[3] for x in own if x[2] == "assistant")
    assert chat.format_chats(d.limit(0)).count() == 0


def test_licences(spark, odd, empty):
    mit = dict(licences.LICENCES)["MIT"]
    d = spark.createDataFrame([(1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ;")), (2, mit + " more"), (3, None)], "doc_id long, text string")
    assert {r.id: r.licence_id for r in licences.scan(d).collect()} == {1: "MIT", 2: None, 3: None}
    wrapped = []
    for name, body in licences.LICENCES:
        for width in range(20, 101):
            for head, mark in (("Copyright (c) 2020 Someone\n(c) 2021 Other\nAll rights reserved.\n\n", ""), ("Copyright 2020, Someone\nCopyright holder: Someone\n\n", " * "), ("", "# ")):
                lines = [x for part in body.split("\n") for x in textwrap.wrap(part, width, break_long_words=False, break_on_hyphens=False) or [""]]
                wrapped.append((len(wrapped), name, "\n".join(mark + x for x in [*head.split("\n"), *lines])))
    assert sum("\ncopyright notice" in x[2].lower() for x in wrapped) > 10
    d2 = spark.createDataFrame(wrapped, "doc_id long, name string, text string")
    assert {(r.id, r.licence_id) for r in licences.scan(d2).collect()} == {(i, name) for i, name, _ in wrapped}
    assert all(sum(name == n for n, _ in licences.LICENCES) > 1 for name in ("MIT", "ISC", "BSD-3-Clause", "Unlicense"))
    assert licences.scan(odd).count() == len(ODD) and licences.scan(empty).count() == 0
    assert not any(x in licences.scan(d)._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))


#: Where the system keeps long licences, by our name.
KEPT = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}


@pytest.mark.parametrize("name", sorted(KEPT))
def test_long_licences(spark, name):
    path = Path("/usr/share/common-licenses") / KEPT[name]
    if not path.exists():
        pytest.skip("the system keeps no licences")
    whole, end = path.read_text(encoding="utf-8"), "END OF TERMS AND CONDITIONS"
    texts = [whole, whole.upper().replace("\n", "\r\n"), "\n".join(" * " + line for line in whole.split("\n")), whole.replace("https://", "http://"), whole + " and more"]
    texts += [whole[: whole.index(end) + len(end)]] if end in whole else []
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.id: r.licence_id for r in licences.scan(d).collect()} == {i: None if i == 4 else name for i in range(len(texts))}


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("tile", [None, (32, 16)])
def test_tiff_round_trip(compression, tile):
    r = np.random.default_rng(0)
    for predictor in (1, 2):
        for shape in ((1, 64), (257, 40), (300, 17)):
            images = [(r.integers(0, 4, shape) * r.integers(0, 2, shape)).astype(np.uint8), r.integers(0, 256, shape).astype(np.uint8)]
            got = list(tiff.decode_pages(tiff.encode(images, compression, predictor, rows=37, tile=tile)))
            assert len(got) == 2 and all((p.samples[:, :, 0] == i).all() for p, i in zip(got, images, strict=True))


def test_media(spark, odd, empty):
    files = media.stored(odd)
    for r in media.features(files).collect():
        assert r.payload_bytes % 64 == 0 and r.payload_bytes >= max(64, r.n_bytes)
    assert media.features(media.stored(empty)).count() == 0
    assert media.pages(files, "id", "media").where("error IS NULL").count() >= len(ODD)
    bad = spark.createDataFrame([(1, bytearray(b"II*\0")), (2, None), (3, bytearray(tiff.encode([np.zeros((4, 4), np.uint8)])[:-20]))], "id long, media binary")
    assert {r.id for r in media.pages(bad, "id", "media").where("error IS NOT NULL").collect()} == {1, 3}
    three = bytearray(tiff.encode([np.full((4, 4), k, np.uint8) for k in range(3)]))
    first = int.from_bytes(three[4:8], "little")
    n = int.from_bytes(three[first : first + 2], "little")
    second = int.from_bytes(three[first + 2 + 12 * n : first + 6 + 12 * n], "little")
    bits = next(k for k in range(second + 2, second + 2 + 12 * n, 12) if int.from_bytes(three[k : k + 2], "little") == tiff.BITS)
    three[bits + 8] = 1
    got = media.pages(spark.createDataFrame([(1, three)], "id long, media binary"), "id", "media").orderBy("page").collect()
    assert [(r.page, r.samples and set(r.samples), r.error is None) for r in got] == [(0, {0}, True), (1, None, False), (2, {2}, True)]


def test_media_equals_plain_python(spark, odd):
    for r, (i, t) in zip(sorted(media.features(media.stored(odd.coalesce(1))).collect(), key=lambda r: (r.id is None, r.id or 0, r.n_bytes, r.payload_sha256)), sorted(ODD, key=lambda x: (x[0] is None, x[0] or 0, len((x[1] or "").encode()), hashlib.sha256(media.payload(x[1])[1]).hexdigest())), strict=True):
        size, data = media.payload(t)
        assert (r.id, r.n_bytes, r.payload_bytes) == (i, size, len(data)) and len(data) == max(64, -(-size // 64) * 64)
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest() and r.tail_crc32 == zlib.crc32(data[-64:])


def test_damaged_media_give_error_rows(spark):
    r, whole = random.Random(0), tiff.encode([np.arange(4096, dtype=np.uint8).reshape(64, 64)] * 2, tile=(32, 32))
    files = [(0, bytearray()), (1, bytearray(whole)), (2, None)]

    def field(tag, value):
        data = bytearray(whole)
        first = int.from_bytes(data[4:8], "little")
        at = next(k for k in range(first + 2, first + 200, 12) if int.from_bytes(data[k : k + 2], "little") == tag)
        data[at + 8 : at + 12] = value.to_bytes(4, "little")
        return data

    files += [(3, field(tiff.TILE_WIDTH, 0)), (4, field(tiff.WIDTH, 2_000_000)), (5, field(tiff.HEIGHT, 4_000_000_000)), (6, field(tiff.TILE_HEIGHT, 2**31))]
    for k in range(200):
        data = bytearray(whole)
        for _ in range(r.randint(1, 8)):
            data[r.randrange(len(data))] = r.randrange(256)
        files.append((10 + k, data[: r.choice([len(data), r.randrange(len(data))])]))
    d = spark.createDataFrame(files, "id long, media binary")
    got = defaultdict(list)
    for row in media.pages(d, "id", "media").collect():
        got[row.id].append(row.error)
    assert set(got) == {i for i, _ in files if i != 2} and got[1] == [None, None] and got[0][0]
    assert all(got[i][0] and got[i][1] is None for i in (3, 4, 5, 6))


def test_packing_equals_plain_tokens(spark, odd):
    coder, got = tokens.Encoder(), defaultdict(list)
    for p in packing.result(packing.pack(odd)).collect():
        got[p.doc_id, p.doc_tokens].append((p.start, p.length, p.ids_crc32))
    want = defaultdict(list)
    for i, t in ODD:
        ids = np.array(coder.tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want[i, len(ids)] += [(k, len(ids[k : k + 1024]), zlib.crc32(ids[k : k + 1024].tobytes())) for k in range(0, len(ids), 1024)]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_mix_comes_near_its_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    by = defaultdict(list)
    for x in mixing.mix(docs).collect():
        assert 0 <= x.taken <= 3 * x.size
        by[x.source].append(x)
    for own in by.values():
        assert abs(sum(x.taken for x in own) - own[0].target) <= 0.02 * own[0].target + max(x.size for x in own)


def test_stages_equal_plain_python(spark):
    """What each stage of the pipeline keeps, on a table with planted copies, names that clash and rows that share an id."""
    from tessera.llm import stages

    r = random.Random(4)
    words = [" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(12)]
    near = [f"{w} tail{k}" for k, w in enumerate(words[:5])]
    data = [(k, t, f"s{k % 3}", k, k * 1.0) for k, t in enumerate([*words, *[w.replace(" ", "\n ") for w in words[:4]], *near, "", None, " "])]
    data += [(3, "another text of id three", "s0", 1, 1.0), (None, "no id", None, 2, 2.0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, _id long, _score double")
    after = stages.drop_copies(docs)
    groups = defaultdict(list)
    for i, t, *_ in data:
        groups["".join((t or "").split())].append((-len(t or ""), i is None, i or 0, t))
    want = sorted((min(g)[2], min(g)[3] or "") for g in groups.values())
    assert sorted((x.doc_id or 0, x.text or "") for x in after.collect()) == want and after.columns == docs.columns
    kept = spark.createDataFrame(after.collect(), docs.schema)
    lone = stages.drop_near_copies(kept)
    rows_ = kept.collect()
    root = brute_groups([x.text for x in rows_])
    assert len({root[k] for k in range(len(rows_))}) == lone.count() and lone.columns == docs.columns
    assert (3, "another text of id three") in {(x.doc_id, x.text) for x in lone.collect()}
    mixed = stages.repeat_to_mix(lone)
    taken = Counter()
    for x in mixing.mix(lone).collect():
        taken[x.id, x.source] += x.passes
    assert Counter((x.doc_id, x.source) for x in mixed.collect()) == +taken and mixed.columns == docs.columns
    clean = stages.drop_toxic(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert clean.count() == docs.count() and clean.columns == docs.columns


def test_arrow_files(spark, odd, empty):
    folder = scratch(spark, "test")
    got = arrow_output.read_tokens(arrow_output.write_tokens(odd, folder), folder).toPandas().sort_values("start")
    coder, at = tokens.Encoder(), 0
    assert len(got) == len(ODD)
    want = Counter()
    for i, t in ODD:
        ids = np.array(coder.tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want[(i, len(ids), zlib.crc32(ids.tobytes()))] += 1
    for r in got.itertuples():
        assert r.start == at
        at += r.n_tokens
        want[(None if np.isnan(r.doc_id) else int(r.doc_id), r.n_tokens, r.ids_crc32)] -= 1
    assert not any(want.values())
    folder = scratch(spark, "test")
    assert arrow_output.read_tokens(arrow_output.write_tokens(empty, folder), folder).count() == 0


PAGE = '<html><head><title>t</title></head><body><header>Site</header><nav><a>x</a></nav><article><header><h1>A &amp; B</h1></header><p>One<br>two  <b>three</b><p>Four<script>var a="</p>";</script></article><div class="comments"><p>no</p></div><form>f</form><footer>&copy;</footer></body></html>'


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        (PAGE, ["A & B", "One two three", "Four"]),
        ('<article><p title="the hidden cost">one</p><p class="a hidden b">two</p><p hidden>no</p></article>', ["one", "two"]),
        ("<article><p>&<b>lt;</b> &amp;lt; a < b</p></article>", ["&lt; &lt; a < b"]),
        ('<article><p title="x>one</p><p>two</p></article>', ["one", "two"]),
        ("<article><p>foo <svg><text>no</text></svg> <button>no</button><script>no</script><math><mi>x</mi></math> bar <noscript>baz</noscript></p></article>", ["foo x bar baz"]),
        ('<article><section id="related-work"><p>one</p></section><p class="share-price">two</p><div class="related-posts">no</div><div class="ad">no</div><div class="shareButtons">no</div></article>', ["one", "two"]),
        ('<main><p>one</p></main><article class="comment"><p>no</p></article><div id="comments"><article><p>no</p></article></div>', ["one"]),
        ("<article><p>one<p>two<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>e</article>", ["one", "two", "a", "b", "c", "d", "e"]),
        ("<article>&#x41;&eacute;&nbsp;\n x<br>y<!-- <p>no</p> --></article>", ["Aé x y"]),
        ("", []),
        ("plain < text", ["plain < text"]),
    ],
)
def test_html_blocks(page, texts):
    assert [t for _, t in html_text.blocks(page)] == texts


def test_html(spark):
    shared = "read this long notice that stands on all of the pages here"
    body = lambda k: f"text{k} of page {'abcdefgh'[k]} and no other page has these words {k * 7}"
    pages = [(k, "http://h/x", f"<body><div>{shared}</div><div>{body(k)}</div><div>{k}{k} only{k} {shared}</div></body>") for k in range(6)]
    other = (10, "http://other/", f"<body><div>{shared}</div></body>")
    repeats = [(11, "http://third/", f"<div>{shared} again</div>")] * 2
    rows_ = [(*r, "z", 1) for r in [*pages, (7, None, None), (8, "http://h/y", ""), (9, "http://g/", PAGE), other, *repeats, (None, "http://h/z", "<p>few</p>")]]
    d = spark.createDataFrame(rows_, "page_id long, url string, html string, text string, key int")
    got = {r.id: r.text for r in html_text.extract(d).collect()}
    assert got[7] == got[8] == "" and got[9] == "A & B\nOne two three\nFour" and got[None] == "few"
    assert got[10] == shared and got[11] == f"{shared} again"
    assert all(got[k] == f"{body(k)}\n{k}{k} only{k}" for k in range(6))
    assert html_text.extract(d).count() == len(rows_) and html_text.extract(d.limit(0)).count() == 0


def test_html_equals_brute_force(spark):
    """Open blocks lose exactly the tokens in runs of RUN tokens that another page of the host has."""
    r = random.Random(0)
    notices = [" ".join(f"n{k}w{i}" for i in range(r.randint(5, 14))) for k in range(6)]
    made = lambda k: "".join(f"<div>{t}</div>" for t in [r.choice(notices), " ".join(r.choice("abcd") for _ in range(30)), f"{r.choice(notices)} own{k} {r.choice(notices)}"])
    pages = [(k, f"http://h{k % 2}/{k}", made(k)) for k in range(40)]
    streams = {k: [t.split() for _, t in html_text.blocks(page)] for k, _, page in pages}
    windows = lambda k: [tuple(sum(streams[k], [])[i : i + html_text.RUN]) for i in range(len(sum(streams[k], [])) - html_text.RUN + 1)]
    seen = defaultdict(set)
    for k in streams:
        for w in windows(k):
            seen[k % 2, w].add(k)
    got = {x.id: (x.text, x.n_cut) for x in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k, parts in streams.items():
        covered = np.zeros(sum(map(len, parts)), bool)
        for i, w in enumerate(windows(k)):
            if len(seen[k % 2, w]) > 1:
                covered[i : i + html_text.RUN] = True
        flat, at, want = sum(parts, []), 0, []
        for p in parts:
            want.append(" ".join(t for t, c in zip(flat[at : at + len(p)], covered[at : at + len(p)], strict=True) if not c))
            at += len(p)
        assert got[k] == ("\n".join(w for w in want if w), int(covered.sum()))


def test_suffix_array_cut_anywhere():
    """However the sorted suffixes are dealt to ranges and batches, those found are the ones that another page has."""
    r = random.Random(1)
    array = sorted((f"h{r.randrange(2)}", r.choice("abcdef"), r.randrange(4) if r.random() < 0.5 else 9, k) for k in range(60))
    pages = defaultdict(set)
    for host, suffix, key, _ in array:
        pages[host, suffix].add(key)
    want = sorted((key, pos) for host, suffix, key, pos in array if len(pages[host, suffix]) > 1)
    schema = pa.schema([("host", pa.string()), ("suffix", pa.string()), ("key", pa.int64()), ("pos", pa.int64())])
    for _ in range(200):
        ends, found = sorted(r.choices(range(len(array) + 1), k=r.randrange(12))), []
        for part, (a, b) in enumerate(zip([0, *ends], [*ends, len(array)], strict=True)):
            seen = html_text._Neighbours(part)
            middle = r.randint(a, b)
            for low, high in ((a, middle), (middle, b)):
                seen.add(pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in array[low:high]], schema))
            found += [row for batch in seen.take(True) for row in batch.to_pylist()]
        edges = sorted((x["edge"], x["host"], x["suffix"], x["low"], x["high"]) for x in found if x["pos"] is None)
        shared = html_text.shared_edges(edges)
        assert sorted((x["key"], x["pos"]) for x in found if x["pos"] is not None and (x["edge"] is None or x["edge"] in shared)) == want


def test_html_array_holds_the_whole_host(spark):
    """A run on an open page counts as repeated where a page with an article has it outside that article, not where it is the article's own."""
    shared, own = "read this long notice that stands on all of the pages here", "these are ten words that the article has as well"
    pages = [(1, "http://h/1", f"<div>{shared}</div><article><p>{own}</p></article>"), (2, "http://h/2", f"<div>{shared}</div><div>{own}</div>"), (3, "http://g/3", f"<div>{shared}</div>")]
    got = {x.id: (x.text, x.n_cut) for x in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: (own, 0), 2: (own, len(shared.split())), 3: (shared, 0)}


def test_html_without_article_tags(spark, sf):
    """Pages whose article and structure tags are taken away: the host's runs must not take the article's own text."""
    whole = spark.read.parquet(f"{sf}/pages.parquet").toPandas()
    bare = whole.assign(html=whole.html.fillna("").str.replace(r"</?article[^>]*>", "", regex=True))
    want = html_text.extract(spark.createDataFrame(whole)).toPandas().set_index("id").text
    got = html_text.extract(spark.createDataFrame(bare)).toPandas().set_index("id").text
    count = lambda t: Counter(t.split())
    both = sum(sum((count(got[k]) & count(want[k])).values()) for k in want.index)
    assert both / sum(len(t.split()) for t in want) > 0.8 and both / sum(len(t.split()) for t in got) > 0.9


INSULTS = "loser idiot pathetic clown moron scum trash worthless disgusting stupid".split()


def disguised(r, word, kind):
    k = r.randrange(1, len(word))
    return {
        "plain": word,
        "inserted": word[:k] + r.choice("abcdefghijklmnopqrstuvwxyz") + word[k:],
        "gapped": " ".join(word),
        "dotted": ".".join(word),
        "starred": word[:k] + "*" + word[k:],
        "stretched": word[:k] + word[k - 1] * 3 + word[k:],
    }[kind]


@pytest.fixture(scope="module")
def machine():
    """A model fitted on sentences of which a quarter holds an insult, and a maker of clean sentences."""
    r = random.Random(0)
    parts = "an the or li st re ing tion ed al er ou wh ble".split()
    clean = lambda: " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(40))
    texts = [clean() for _ in range(900)] + [f"{clean()} {r.choice(INSULTS)} {clean()}" for _ in range(300)]
    return toxicity.fit(texts, [0] * 900 + [1] * 300), clean


@pytest.mark.parametrize("kind", ["plain", "inserted", "gapped", "dotted", "starred", "stretched"])
def test_toxicity_recall_by_form(machine, kind):
    r, (model, clean) = random.Random(1), machine
    score = toxicity.Scorer(model).texts(pa.array([f"{clean()} {disguised(r, INSULTS[k % 10], kind)} {clean()}" for k in range(300)]))
    assert (score >= toxicity.THRESHOLD).mean() >= 0.9


def test_toxicity_leaves_clean_sentences(machine):
    model, clean = machine
    assert (toxicity.Scorer(model).texts(pa.array([clean() for _ in range(500)])) < toxicity.THRESHOLD).mean() >= 0.99


def test_toxicity_odd_units(machine):
    """Slices of units without letters, of one letter, of none, and a long table of numbers after ordinary words."""
    model, clean = machine
    scorer = toxicity.Scorer(model)
    numbers = " ".join(map(str, range(10**6, 10**6 + 30_000)))
    score = scorer.texts(pa.array(["12 34 56", "", None, numbers, f"{clean()} {numbers} idiot", "a", "x y", "!!! ???"]))
    assert score[4] >= toxicity.THRESHOLD and (np.delete(score, 4) < toxicity.THRESHOLD).all()
    assert toxicity.Scorer(model).texts(pa.array([], pa.string())).tolist() == []
    for units in ([""], ["a"], ["", "", "idiot", ""], [""] * 5000 + ["idiot"] + [""] * 5000):
        kernel = toxicity.sk.Landmarks(["idiot"]).kernel(units)
        assert [u for u, k in zip(units, kernel[:, 0], strict=True) if k > 0.5] == [u for u in units if u == "idiot"]


def test_kernel_equals_brute_force():
    def features(unit):
        word, out = [-1, *unit, -1], defaultdict(float)
        for i in range(len(word)):
            for k in range(i + 2, min(i + toxicity.sk.SPAN, len(word))):
                for j in range(i + 1, k):
                    out[word[i], word[j], word[k]] += toxicity.sk.DECAY ** (k - i + 1)
        return out

    r = random.Random(2)
    units = ["".join(r.choice("abcde") for _ in range(r.randint(1, 12))) for _ in range(40)]
    got = toxicity.sk.Landmarks(units).kernel(units)
    each = [features(u) for u in units]
    dot = lambda x, y: sum(v * y.get(k, 0) for k, v in x.items())
    for i, x in enumerate(each):
        for j, y in enumerate(each):
            assert abs(got[i, j] - dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))) < 1e-5


def test_toxicity(spark, odd, empty, machine):
    model, _ = machine
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= x["score"] <= 1 for x in got)
    texts = {i: {x["score"] for x in got if x.id == 7 and x.doc_id == i} for i in (1, 2, 3)}
    assert texts[1] == texts[2] == texts[3]
    nothing = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not nothing.landmarks and {x["score"] for x in toxicity.score(odd, nothing).collect()} == {0.0}
    assert toxicity.score(empty, model).count() == 0
    with pytest.raises(ValueError):
        toxicity.score(odd, model, column="MARK")


def test_toxicity_learns_from_its_rows_only(spark):
    """Held-out rows, null labels and null texts teach nothing; of several labels of an id the toxic one counts."""
    r = random.Random(3)
    docs = [(i, " ".join(r.choice("abcdefghij") * 3 + str(i % 7) for _ in range(5)) + (" idiot" if i % 4 == 0 else "")) for i in range(400)] + [(None, "x"), (500, None)]
    labels = [(i, int(i % 4 == 0) if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - int(i % 4 == 0)) for i in range(400)] + [(5, None), (None, 1), (500, 1)]
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert (toxicity.Scorer(model).texts(pa.array(["abc idiot", "abc def"])) >= toxicity.THRESHOLD).tolist() == [True, False]


def test_pipeline(spark, sf):
    import corpus_pipeline as p
    from tessera.llm.common import read

    docs = read(spark, sf, "documents")
    for name, stage in p.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns
        docs = p.written(out, name)
    assert docs.count() > 0


def test_kernel_memory():
    """Comparing many units takes a few slices' memory, not one of thousands of units by all landmarks."""
    r = random.Random(4)
    units = ["".join(r.choice("abcdefgh") for _ in range(10)) for _ in range(4000)]
    against = toxicity.sk.Landmarks(units[:64])
    tracemalloc.start()
    try:
        got = against.kernel(units)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40_000_000 and (got == against.kernel(units, step=2000)).all()


def test_tables_of_numbers_are_few_files(spark):
    most = common.FILES * spark.sparkContext.defaultParallelism
    rows_ = spark.range(0, 5000, 1, most + 40)
    table = common.written(rows_, "numbers", few=True)
    assert len(table.inputFiles()) <= most and sorted(x.id for x in table.collect()) == list(range(5000))
    assert len(common.written(rows_, "all").inputFiles()) == most + 40
    large = spark.range(0, 5000, 1, most + 40).join(spark.range(common.FILE_BYTES * (most + 30) // 8), "id", "left_semi")  # bytes for more files
    assert common.bytes_read(large) // common.FILE_BYTES >= most + 30


@pytest.mark.parametrize("made", [exact_dedup.distinct_blocks, exact_dedup.described])
def test_exact_dedup_works_on_slices(monkeypatch, made):
    """A large Arrow batch is not turned into Python strings as a whole."""

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            batch = pa.RecordBatch.from_arrays([pa.array(["x" * 100_000] * 100), pa.array(range(100))], ["text", "doc_id"])
            return list(f(iter([batch])))

    sizes = []
    monkeypatch.setattr(exact_dedup, "_texts", lambda batch, f=exact_dedup._texts: (sizes.append(batch.num_rows), f(batch))[1])
    monkeypatch.setattr(exact_dedup.F, "col", lambda name: name)
    out = made(Docs(), "text", 4096) if made is exact_dedup.distinct_blocks else made(Docs(), "doc_id", "text", 4096)
    assert len(sizes) > 1 and sum(sizes) == 100 and max(sizes) < 100 and out
