"""Each operator against a brute-force version, and on nulls, empty texts, repeats, ties and odd columns."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tideframe.llm import blocksort, decontaminate, language, mixing, neardup, pages, quality, substrings, suffix_tree, tokens, toxicity
from tideframe.llm.components import components

WORDS = "the of and to in a is that for with river stone cloud amber walked under slowly bright seven engine paper".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows, extra=True):
    """doc_id and text beside columns whose names clash with what operators use inside."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    wide = [(i, t, "k", 7, "x", 1.5, "s", len(t or "")) for i, t in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, key string, n long, word string, score double, source string, n_chars long").repartition(3)


ODD = [(None, "no id here"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "x" * 3000), (6, "é ü ß 中文 🙂 " * 30)]


def crc(i, m):
    return zlib.crc32(("" if i is None else str(i)).encode()) % m


# -- quality ----------------------------------------------------------------------------------------


def brute_quality(t):
    import re

    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    hit = {i + k for i, g in enumerate(tri) if n[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_quality(spark):
    rng = random.Random(1)
    rows = [*ODD, (10, prose(rng, 300)), (11, "a b c " * 40), (12, prose(rng, 60) + "\nsame\nsame\n" + prose(rng, 20)), (13, "### *** " * 60), (14, prose(rng, 5000))]
    got = quality.report(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:6]) for r in got) == sorted((str(i), *brute_quality(t)) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in got if r.kept}
    df = frame(spark, rows)
    out = quality.keep(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == kept and 13 not in kept
    assert quality.report(frame(spark, [])).count() == 0


# -- tokens -----------------------------------------------------------------------------------------


def test_tokens_equal_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(2)
    pool = ["a", "É", "é", "Σ", "σΣ", "İ", "<|endoftext|>", "<|", "<|startoftext|>", " ", "\n", "\x1c", "\x85", "\xa0", "²", "'LL", "don't", "中", "🙂", "　", "_-", "\x00", "K"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 20))) for _ in range(400)]
    rows = [*ODD, *((100 + i, t) for i, t in enumerate(texts)), (9, prose(rng, 3000))]
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(frame(spark, rows), path).collect()}
    n = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    assert got == {(i, len((t or "").encode()), n(t), n(t) > 2048) for i, t in rows}
    assert tokens.count_tokens(frame(spark, []), path).count() == 0


# -- pages ------------------------------------------------------------------------------------------

SENTENCE = "The river, slow and bright, turned under the old bridge; nobody looked. "


def test_pages(spark):
    page = (
        "<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t='</p>';</script></head><body class='has-sidebar'><header><h1>Site</h1></header>"
        "<nav><ul><li><a href=/a>a</a><li><a href=/b>b</a></ul></nav><!-- ad --><div class='ad'>Buy it, now.</div><article><h1>Head&amp;line</h1>"
        f"<p><b>{SENTENCE}<br>More&nbsp;text\n  here.<p>{SENTENCE * 3}</p><ul><li>first item, long enough to read.</li></ul></article>"
        f"<section class='comments'><p>{SENTENCE}</p></section><form><p>Sign up</p></form><footer>&copy; x</footer></body>"
    )
    want = "\n".join(["Head&line", (SENTENCE + "More text here.").strip(), (SENTENCE * 3).strip(), "first item, long enough to read."])
    assert pages.main_text(page) == want
    soup = f"<div id='menu'><a href=x>Home</a></div><div id='content'><h2>Title</h2><div>{SENTENCE * 2}</div><div>{SENTENCE}</div></div><div class='sidebar'>{SENTENCE}</div>"
    assert pages.main_text(soup) == "\n".join(["Title", (SENTENCE * 2).strip(), SENTENCE.strip()])
    for odd in (None, "", "<", "<p", "<!-- never closed <p>x", "<div class='a", "</p></div>", "<p>" * 3000 + "x", '<a title="' * 500):
        assert isinstance(pages.main_text(odd), str)
    # names are a penalty, paths decide: words of the article survive their class, a link, a caption, a table
    inner = (
        f"<h1>T</h1><p>{SENTENCE * 2}</p><p class='share-price'>Up 3 %.</p><p><a href=x>A linked sentence.</a></p><figure><figcaption>Caption.</figcaption></figure>"
        "<table><tr><td>1</td><td>x</td></tr></table><div class='social-share'><a>Tweet</a></div><div class='ad-slot'>Buy.</div><ul class=tags><li><a href=q>t</a></li></ul>"
    )
    want = "\n".join(["T", (SENTENCE * 2).strip(), "Up 3 %.", "A linked sentence.", "Caption.", "1", "x"])
    thread = f"<p>{SENTENCE * 4}</p>" * 6
    assert pages.main_text(f"<div class='layout has-sidebar'><nav>n</nav><article>{inner}</article><div class=sidebar>{SENTENCE}</div></div><div class=comments>{thread}</div>") == want
    assert pages.main_text(f"<form id=f><div id=menu><a>x</a></div><main>{inner}</main><input value=1></form><div class=cookie-notice>{SENTENCE}</div>") == want
    # nothing but deep nesting, with stray ends: linear in the page
    deep = pages.main_text("<div>" * 20_000 + f"<p>{SENTENCE}</p></section></li>" * 500)
    assert deep == "\n".join([SENTENCE.strip()] * 500)
    assert pages.main_text(f"<p>{SENTENCE * 50_000}") == (SENTENCE * 50_000).strip()
    want = "\n".join(["Head&line", (SENTENCE + "More text here.").strip(), (SENTENCE * 3).strip(), "first item, long enough to read."])
    rows = [(1, "u", page, 5), (None, None, None, 6), (1, "u", page, 5)]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text long"))
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got.collect()) == sorted([("1", want, len(want)), ("None", "", 0), ("1", want, len(want))])


# -- language ---------------------------------------------------------------------------------------


def test_language(spark):
    rng = random.Random(3)
    make = {"aa": "bana nama tala kasa raga".split(), "oo": "molo poro tuno golo zoro".split()}
    rows = [(i, " ".join(rng.choice(make[lang]) for _ in range(20)), lang) for i in range(60) for lang in make]
    train = spark.createDataFrame([*rows[:80], (1, None, "aa"), (2, "zzz", None)], "doc_id long, text string, lang string")
    proto = language.learn(train)
    assert list(proto) == ["aa", "oo"]
    got = language.predict(frame(spark, [(i, t) for i, t, _ in rows[80:]] + ODD), proto).collect()
    truth = {(i, lang) for i, _, lang in rows[80:]}
    assert sum((r.doc_id, r.lang_pred) in truth for r in got) == len(truth)
    assert all(0 <= r.score <= 1 for r in got) and all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert {r.lang_pred for r in language.predict(frame(spark, ODD), {}).collect()} == {"und"}
    # the bundle is the sum of bound, permuted letter vectors
    text, d = "ab1 Ba", language.DIMENSIONS
    v = {c: language.letter_vector(ord(c) if c != " " else 0, d).astype(int) for c in "ab "}
    padded = " ab ba "
    want = sum(np.roll(v[padded[i]], 2) * np.roll(v[padded[i + 1]], 1) * v[padded[i + 2]] for i in range(len(padded) - 2))
    assert np.array_equal(language.profiles([text])[0], want)


# -- toxicity ---------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(4)
    bad = "vexgrunt snarlpit".split()
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        w = prose(rng, 80).split()
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    lab = spark.createDataFrame([*labels, (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    model = toxicity.fit(*toxicity.sample(docs, lab))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert sum(got[i].predicted == t for i, _, t in labels) >= 295
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert toxicity.score(frame(spark, ODD), model).count() == len(ODD)
    empty = toxicity.fit([], [])
    assert {r.score for r in toxicity.score(frame(spark, ODD), empty).collect()} == {0.0}


# -- mixing -----------------------------------------------------------------------------------------


def test_mixing(spark):
    rows = [(i, f"t{i}", "a" if i % 3 else None) for i in range(600)] + [(7, "again", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, {"a": 3.0, "": 1.0}, epochs=2.0).collect()
    n = Counter(r.source for r in got)
    assert abs(n["a"] - 900) < 120 and abs(n[None] - 300) < 80
    assert Counter(r.copy for r in got if r.text == "t7") == Counter(range(sum(r.text == "t7" for r in got)))
    rate = {"a": 2.0 * 601 * 0.75 / 401, None: 2.0 * 601 * 0.25 / 200}
    for r in docs.collect():  # the draw is the inverted distribution at the hash
        u = int(hashlib.md5(f"{mixing.SEED}|{r.doc_id}|1".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate[r.source])
        c = p
        while c <= u:
            k += 1
            p *= rate[r.source] / k
            c += p
        assert sum(x.doc_id == r.doc_id and x.text == r.text for x in got) == k
    assert mixing.mix(docs, {"a": 1.0}).where("source is null").count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0
    big = mixing.mix(docs.limit(4), None, epochs=300.0).count()
    assert 900 < big < 1500


# -- near duplicates --------------------------------------------------------------------------------


def brute_classes(rows):
    first, parent = {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    rows = sorted((i, t or "") for i, t in rows if i is not None)
    sets = {}
    for i, t in rows:
        parent.setdefault(i, i)
        j = first.setdefault(t, i)
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = list(sets)
    for x in range(len(ids)):
        for y in range(x):
            p, q = sets[ids[x]], sets[ids[y]]
            if p and q and len(p & q) >= 0.8 * len(p | q):
                a, b = find(ids[x]), find(ids[y])
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


def test_near_duplicates(spark):
    rng = random.Random(5)
    rows = list(ODD)
    rows[5] = (4, "one")
    for g in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 60, 200]))]
        for c in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(4000)}"
            rows.append((100 + g * 10 + c, " ".join(w)))
    got = neardup.classes(frame(spark, rows)).collect()
    want = brute_classes(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert all(r.class_id is None and r.kept for r in got if r.doc_id is None)
    kept = neardup.keep_one(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(want.values()))
    assert kept.columns == frame(spark, rows).columns
    assert neardup.classes(frame(spark, [])).count() == 0


def test_near_copies_without_their_original(spark):
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(204)]
    rows = []
    for i in range(300):
        w = list(base)
        at = rng.randrange(196)
        w[at : at + 8] = [f"e{rng.randrange(10**6)}" for _ in range(8)]
        rows.append((i, " ".join(w)))
    texts = [t.encode() for _, t in rows]
    known = neardup.frequent(frame(spark, rows))
    found = neardup.bands(texts, known)
    near = [(i, j) for i in range(300) for j in range(i) if any(x == y for x, y in zip(found[i][: neardup.BANDS], found[j]))]
    links = [p for p, s in zip(near, neardup.similar([texts[i] for i, _ in near], [texts[j] for _, j in near], known)) if s >= 0.8]
    label = list(range(300))
    for _ in rows:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    assert 0 < len(links) < len(near)
    assert {r.doc_id: r.class_id for r in neardup.classes(frame(spark, rows)).collect()} == dict(enumerate(label))


def test_weighted_sampling_agrees_as_weighted_jaccard():
    rng = random.Random(6)
    agree = total = 0
    for _ in range(40):
        w = [f"v{rng.randrange(10**6)}" for _ in range(300)]
        x = list(w)
        for k in rng.sample(range(300), 12):
            x[k] = f"u{rng.randrange(10**6)}"
        a, b = (" ".join(t).encode() for t in (w, x))
        s = neardup.similar([a], [b], (np.zeros(0, np.uint64), np.zeros(0)))[0]
        p, q = neardup.bands([a, b], (np.zeros(0, np.uint64), np.zeros(0)))
        agree += sum(m == n for m, n in zip(p[: neardup.BANDS], q))
        total += neardup.BANDS * s**neardup.ROWS
    assert abs(agree / total - 1) < 0.2


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}


# -- repeated substrings ----------------------------------------------------------------------------


def brute_cut(rows):
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, int.from_bytes(hashlib.md5((r[1] or "").encode()).digest()[:7]))):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i, t] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [substrings.HOT, 2])
def test_repeated_substrings(spark, hot):
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = list(ODD) + [(50, "first of two " * 20), (50, "second of two " * 20)]
    for i in range(60, 140):
        parts = []
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(2600)
            parts.append(base[k : k + rng.choice([20, 99, 100, 101, 180, 390])])
            if rng.random() < 0.4:
                parts.append("".join(rng.choice("xyzé") for _ in range(rng.randint(0, 120))))
            if rng.random() < 0.1:
                parts.append(rng.choice(["a", "ab", "abcabd"]) * rng.randint(10, 120))
        rows.append((i, "".join(parts)))
    got = substrings.report(frame(spark, rows), hot=hot).collect()
    want = brute_cut(rows)
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in got) == sorted((str(i), *want[i, t]) for i, t in rows)
    out = substrings.strip(frame(spark, rows), hot=hot)
    assert out.columns == frame(spark, rows).columns and out.count() == len(rows)
    assert substrings.report(frame(spark, [])).count() == 0


def test_repeats_across_pieces(spark):
    rng = random.Random(81)
    long = "".join(rng.choice("abcdefgh ") for _ in range(2 * substrings.PIECE + 5000))
    cut = substrings.PIECE
    rows = [(1, long), (2, "x" + long[cut - 3000 : cut + 3000]), (3, long[7:cut] + "y" + long[cut + 50 : cut + 149]), (4, long[cut - 99 : cut + 1])]
    want = brute_cut(rows)
    assert sorted(tuple(r) for r in substrings.report(frame(spark, rows)).collect()) == [(i, *want[i, t]) for i, t in rows]


def test_repeats_take_little_memory():
    class Frame:
        def mapInArrow(self, function, schema):
            return function

    rng = random.Random(82)
    word = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(5000)]
    texts = [" ".join(rng.choices(word, k=n)) for n in [250] * 1000 + [250_000]]  # 2 MB in short texts, 2 MB in one
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc", "text"])
    find = substrings._rows(Frame(), False)
    sizes = []
    tracemalloc.start()
    sizes += [b.num_rows for b in find(iter([batch]))]
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert max(sizes) <= 20_000 and sum(sizes) > 90_000
    assert most < 80 << 20, most


def test_block_sorting_orders_like_bytes():
    c = blocksort.COVER
    assert {(a - b) % blocksort.PERIOD for a in c for b in c} == set(range(blocksort.PERIOD))
    rng = random.Random(9)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(200)) * 3 + b"c" * 150 + bytes(rng.choice(b"abc") for _ in range(300)), np.uint8)
    block = blocksort.Block(data)
    raw = data.tobytes()
    for r in range(blocksort.PERIOD):
        at = np.arange(r, len(data) - blocksort.LENGTH, blocksort.PERIOD)
        order, same = block.sort(at, np.zeros(len(at), np.int64), r)
        strings = [raw[i : i + blocksort.LENGTH] for i in at[order]]
        equal = [False] + [a == b for a, b in zip(strings, strings[1:])]
        assert same.tolist() == equal


# -- decontamination --------------------------------------------------------------------------------


def test_decontamination(spark):
    item = "Alice has 3 apples and buys 5 more apples for 2 dollars each before she meets Carl near the old mill"
    plain = "the quiet river runs past seven stone houses before it meets the wide and empty sea"
    bench = spark.createDataFrame([(1, item), (2, plain), (3, "too short"), (4, None), (2, plain), (None, plain)], "item_id int, text string")
    moved = "Bob has 7 apples and buys 9 more apples for 4 euros each before she meets Dan near the old mill"
    rows = [
        *ODD, (20, f"Intro. {moved} End."), (21, f"x {plain.upper()} y"), (22, moved.replace("Dan", "Bob")), (23, "all about river stones and the wide sea"),
        (24, "start " + " ".join(plain.split()[:9]) + " then other things"), (25, item), (25, item),
    ]
    got = {(r.doc_id, r.contaminated, tuple(r.item_ids)) for r in decontaminate.find(frame(spark, rows), bench).collect()}
    hit = {i: ids for i, bad, ids in got if bad}
    assert hit == {20: (1,), 21: (2,), 24: (2,), 25: (1,)}
    clean = decontaminate.clean(frame(spark, rows), bench)
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _ in rows if i not in hit)
    assert decontaminate.find(frame(spark, rows), bench.limit(0)).where("contaminated").count() == 0


def brute_found(text, items):
    """Items found by comparing every window of the text with every window of every item."""
    d = decontaminate
    written = d.Written.of({w for _, t in items for w in d.plain_words(t)})
    tokens, words = d.template(text, written)
    out = set()
    for item, t in items:
        mine, own = d.template(t, written)
        if not d.tellable(mine):
            continue
        size, covered = min(8, len(mine)), set()
        for shift in range(-len(mine), len(tokens)):
            at = [p for p in range(len(mine) - size + 1) if p + shift >= 0 and tokens[p + shift : p + shift + size] == mine[p : p + size]]
            held = {k for p in at for k in range(p, p + size)}
            stands = {(mine[k], own[k], words[k + shift]) for k in held if mine[k][0] == "\0"}
            names = {(x, y) for kind, x, y in stands if kind == d.NAME}
            if len({(k, x) for k, x, _ in stands}) < len(stands) or len({y for _, y in names}) < len(names):
                held = {k for p in at if words[p + shift : p + shift + size] == own[p : p + size] for k in range(p, p + size)}
            covered |= held
        if len(covered) * 2 >= len(mine):
            out.add(item)
    return out


def test_decontamination_equals_brute_force_at_any_block_size(spark):
    rng = random.Random(31)
    names, some = ["Anna", "Boris", "Carla", "Deng", "The", "Stone"], WORDS + ["km", "dollars", "3", "17", "4.5"]
    word = lambda: rng.choice(names) if rng.random() < 0.15 else rng.choice(some)
    items = [(i % 50, " ".join(word() for _ in range(rng.choice([2, 4, 7, 9, 14, 30])))) for i in range(60)]
    rows = list(ODD)
    for i in range(100, 220):
        parts = [prose(rng, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(items)[1].split()
            if rng.random() < 0.6:  # other values in the slots, now and then not the same throughout
                to = {x: rng.choice(names[:4]) if x in names else rng.choice(["9", "21", "x", x]) if x[0].isdigit() else x for x in w}
                w = [to[x] if rng.random() < 0.95 else word() for x in w]
            parts += [" ".join(w[: rng.randint(1, len(w))]), prose(rng, rng.randint(0, 9))]
        rows.append((i, " ".join(parts)))
    bench = spark.createDataFrame(items, "item_id int, text string")
    want = {i: brute_found(t, items) for i, t in rows}
    assert sum(map(bool, want.values())) > 30
    for limit in (100, 500_000):
        got = decontaminate.find(frame(spark, rows), bench, block_windows=limit).collect()
        assert len(got) == len(rows) and all(set(r.item_ids) == want[r.doc_id] and r.contaminated == bool(want[r.doc_id]) for r in got)
        left = decontaminate.clean(frame(spark, rows), bench, block_windows=limit)
        assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in rows if not want[i]) and left.columns == frame(spark, rows).columns


def test_decontamination_keeps_all_texts_of_an_item(spark):
    one, two = "the grey heron waits beside the slow canal until dusk", "seven wooden boats drift past the quiet northern harbour"
    bench = spark.createDataFrame([(1, one), (1, two), (None, "every lantern along the old bridge was lit before midnight"), (3, "4 km")], "item_id int, text string")
    rows = [(1, one), (2, two), (3, "x every lantern along the old bridge was lit before midnight y"), (4, "it is 4 km away")]
    got = {r.doc_id: (r.contaminated, r.n_items, r.item_ids) for r in decontaminate.find(frame(spark, rows), bench).collect()}
    assert got == {1: (True, 1, [1]), 2: (True, 1, [1]), 3: (True, 0, []), 4: (False, 0, [])}
    assert [r.item_id for r in decontaminate.skipped(bench).collect()] == [3]
    # 19 of 20 tokens word for word, one slot value changed
    long = "Mara paid 3 dollars for bread and 3 dollars for milk at the corner shop near the station on friday"
    bench = spark.createDataFrame([(7, long)], "item_id int, text string")
    changed = long.replace("and 3", "and 4")
    assert [r.item_ids for r in decontaminate.find(frame(spark, [(1, changed)]), bench).collect()] == [[7]]


# -- language model ---------------------------------------------------------------------------------


def test_suffix_tree(spark):
    rng = random.Random(10)
    rows = [*ODD, *((100 + i, prose(rng, rng.randint(0, 120)).upper()) for i in range(80)), (100, None)]
    docs = frame(spark, rows)
    train = [(i, t) for i, t in rows if crc(i, 7) != 2]
    got = suffix_tree.score(docs, frame(spark, train)).collect()
    words = lambda t: (t or "").encode().lower().split()
    c = Counter(w for _, t in train for w in words(t))
    total, size, ends = sum(c.values()) + len(train), len(c) + 1, len(train)
    log = lambda n: math.log10((n + 1) / (total + size + 1))
    want = Counter()
    for i, t in rows:
        w = words(t)
        want[i, len(w) + 1, sum(c[x] > 0 for x in w) + 1, total, round(sum(log(c[x]) for x in w) + log(ends), 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got) and sum(r.score for r in got if r.doc_id and r.doc_id >= 100) > sum(r.base_score for r in got if r.doc_id and r.doc_id >= 100)
    none = suffix_tree.score(docs, docs.limit(0)).collect()
    assert {r.base_score for r in none} == {0.0} and {r.train_tokens for r in none} == {0}


# -- any column type and name, empty tables, texts of some MB ----------------------------------------

INTERNAL = "row key node label id doc sub place part code found n count source copy_ size bands parts text_ _gone _source _count".split()


def odd_frame(spark, rows):
    """String ids, some null or repeated with other texts, beside columns named like what operators use inside."""
    from pyspark.sql import functions as F

    wide = spark.createDataFrame(rows, "doc_id string, text string")
    return wide.select("*", *[F.lit(f"mine {c}").alias(c) for c in INTERNAL]).repartition(3)


def test_all_operators_take_any_columns_and_empty_tables(spark):
    rng = random.Random(33)
    base = prose(rng, 200)
    rows = [(None, "a"), (None, "b"), (None, base), (None, base), ("x", None), ("x", base + " more"), ("y", base), ("y", base), ("z", prose(rng, 90)), ("\u00e9", " \n ")]
    docs, none = odd_frame(spark, rows), odd_frame(spark, rows).limit(0)
    bench = spark.createDataFrame([("i", "seven bright engines under the amber cloud of stone")], "item_id string, text string")
    prototypes = language.learn(spark.createDataFrame([("en", base), ("xx", "qzk wvx jjq")], "lang string, text string"))
    model = toxicity.fit([t for _, t in rows], [0] * len(rows))
    public_tokenizers = pytest.importorskip("public_tokenizers")
    runs = {
        "op1": lambda d: toxicity.score(d, model), "op2": neardup.classes, "op3": quality.report, "op4": lambda d: language.predict(d, prototypes),
        "op6": substrings.report, "op7": lambda d: decontaminate.find(d, bench), "op8": lambda d: tokens.count_tokens(d, public_tokenizers.path("word_bpe_49k.json")),
        "op9": lambda d: pages.extract(d, "doc_id", "text", "text"), "op10": lambda d: suffix_tree.score(d, d),
    }
    for name, run in runs.items():
        assert run(docs).count() == len(rows), name
        assert run(none).count() == 0, name
    for name, run in {"keep_one": neardup.keep_one, "strip": substrings.strip, "clean": lambda d: decontaminate.clean(d, bench), "keep": quality.keep}.items():
        out = run(docs)
        assert out.columns == docs.columns and run(none).count() == 0, name
        assert all(r[c] == f"mine {c}" for r in out.collect() for c in INTERNAL), name
    mixed = mixing.mix(docs, epochs=3.0)
    assert mixed.columns == [*docs.columns, "copy", "mix_key"] and mixing.mix(none).count() == 0
    assert all(r[c] == f"mine {c}" for r in mixed.collect() for c in INTERNAL)
    # of class {x more, y, y} the row with the least id stays; null ids stay
    kept = sorted((str(r.doc_id), str(r.text)) for r in neardup.keep_one(docs).collect())
    assert kept == sorted([("None", "a"), ("None", "b"), ("None", base), ("None", base), ("x", "None"), ("x", base + " more"), ("z", rows[8][1]), ("\u00e9", " \n ")])


def test_repeated_substrings_of_any_ids(spark):
    rng = random.Random(34)
    base = "".join(rng.choice("abcdefgh ") for _ in range(900))
    texts = [base[k : k + 300] for k in range(0, 600, 90)] + [base[:250]] * 2
    for ids in (["b", "a", None, None, "c", "a", "\u00e9", None, "a"], [5, 2**63 - 1, None, -7, 1, 1, 2**63 - 2, None, 3]):
        rows = list(zip(ids, texts))
        docs = spark.createDataFrame(rows, "doc_id string, text string" if "a" in ids else "doc_id long, text string").repartition(3)
        want = brute_cut([(i.encode() if isinstance(i, str) else i, t) for i, t in rows])
        got = substrings.report(docs).collect()
        key = lambda i: i.encode() if isinstance(i, str) else i
        assert sorted((str(key(r.doc_id)), *tuple(r)[1:]) for r in got) == sorted((str(key(i)), *want[key(i), t]) for i, t in rows)


def test_mixing_with_more_sources_than_are_broadcast(spark):
    rows = [(i, f"t{i}", f"s{i % 40}" if i % 3 else "big") for i in range(400)] + [(None, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    some = [sorted(map(str, mixing.mix(docs, broadcast_sources=k).collect())) for k in (2_000, 5)]
    assert some[0] == some[1] and len(some[0]) > 200


def test_very_long_texts(spark):
    rng = random.Random(35)
    han = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(60_000))
    long = prose(rng, 250_000)
    docs = frame(spark, [(1, han), (2, long), (3, "short one"), (4, long[:900_000] + " end")])
    prototypes = language.learn(spark.createDataFrame([("zh", han[:5000]), ("en", long[:5000])], "lang string, text string"))
    assert {r.doc_id: r.lang_pred for r in language.predict(docs, prototypes).collect()} == {1: "zh", 2: "en", 3: "en", 4: "en"}
    cut = {r.doc_id: (r.n_bytes, r.n_removed) for r in substrings.report(docs).collect()}
    assert cut[1] == (180_000, 0) and cut[4][1] >= 899_900
    assert suffix_tree.score(docs, docs).count() == 4
    assert sum(r.n_known for r in suffix_tree.score(docs, docs).collect()) == sum(len(t.split()) + 1 for t in (han, long, "short one", long[:900_000] + " end"))
    bench = spark.createDataFrame([(1, " ".join(long.split()[-40:]))], "item_id int, text string")
    assert {r.doc_id for r in decontaminate.find(docs, bench).where("contaminated").collect()} == {2}


def brute_tree_score(texts, train):
    """log10 probability of each text: every byte by its longest retained context, found anew for each."""
    d = suffix_tree.DEPTH
    lead = bytes([suffix_tree.END]) * d
    n, m = Counter(), Counter()
    for t in train:
        b = lead + suffix_tree.symbols(t)
        for at in range(d, len(b)):
            for k in range(d + 1):
                n[b[at - k : at + 1]] += 1
                m[b[at - k : at]] += 1
    kept = {b""}

    def prob(context, x):  # by the longest retained suffix of context
        while context not in kept:
            context = context[1:]
        below = prob(context[1:], x) if context else 1 / 256
        return (n[context + bytes([x])] + suffix_tree.PRIOR * below) / (m[context] + suffix_tree.PRIOR)

    after = {}
    for run in n:
        after.setdefault(run[:-1], []).append(run[-1])
    for context in sorted(after, key=len):
        if context and m[context] >= suffix_tree.LEAST_COUNT:
            gain = sum(n[context + bytes([x])] * math.log(n[context + bytes([x])] / m[context] / prob(context[1:], x)) for x in after[context])
            if gain >= suffix_tree.LEAST_GAIN:
                kept.add(context)
    out = []
    for t in texts:
        b = lead + suffix_tree.symbols(t)
        out.append(sum(math.log10(prob(b[at - d : at], b[at])) for at in range(d, len(b))))
    return out, kept


def test_suffix_tree_equals_the_longest_retained_suffix_of_each_byte(spark):
    rng = random.Random(32)
    train = [(i, prose(rng, rng.randint(5, 60))) for i in range(60)]
    rows = [*ODD, (50, "unseen zebra quartz"), (51, None), *((100 + i, prose(rng, 30) + " River of the") for i in range(20))]
    want, kept = brute_tree_score([(t or "").encode() for _, t in rows], [t.encode() for _, t in train])
    assert len({len(c) for c in kept}) == suffix_tree.DEPTH + 1
    for held in (10**6, 200, 1):  # all of the tree in the workers, some of it, hardly any
        got = suffix_tree.score(frame(spark, rows), frame(spark, train), held=held).collect()
        assert np.allclose(sorted(r.score for r in got), sorted(want), rtol=1e-5, atol=1e-4)


def test_suffix_tree_is_a_distribution(spark):
    train = [(1, "abab abba ab"), (2, "ba ab abab"), (3, "abba")] * 30
    lead = np.array([10, 97, 98, 97, 32], np.uint64)
    codes = sum(c << np.uint64(8 * (5 - k)) for k, c in enumerate(lead)) | np.arange(256, dtype=np.uint64)
    tree, _ = suffix_tree.held_part(suffix_tree.levels(suffix_tree.count_runs(frame(spark, train))), 10**6)
    for cut in range(6):  # behind contexts that were seen, partly seen, and never seen
        some = codes | np.uint64(int.from_bytes(b"~" * cut + bytes(6 - cut)))
        log, left = tree.lookup(some)
        assert not left.any() and abs((10**log).sum() - 1) < 1e-5


def test_suffix_tree_across_pieces(spark, monkeypatch):
    rng = random.Random(36)
    train = [(i, prose(rng, rng.randint(5, 60))) for i in range(60)]
    texts = [(t or "").encode() for _, t in ODD] + [prose(rng, 400).encode(), b"", b"", b"unseen zebra", prose(rng, 90).encode()]
    want, _ = brute_tree_score(texts, [t.encode() for _, t in train])
    tables = suffix_tree.levels(suffix_tree.count_runs(frame(spark, train)))
    for held in (10**6, 200):
        tree, _ = suffix_tree.held_part(tables, held)
        whole = tree.scores(texts)
        assert len(list(suffix_tree._runs(texts))) == 1
        for piece in (1, 7, 64, 1000):  # shorter than a lead, a word, a text, longer than most
            monkeypatch.setattr(suffix_tree, "PIECE", piece)
            cut = tree.scores(texts)
            assert len(list(suffix_tree._runs(texts))) > 3 and np.allclose(cut[0], whole[0])
            for i in range(len(texts)):
                of = [Counter(), Counter()]
                for c, (_, starts, codes, n) in zip(of, (whole, cut)):
                    for k in range(starts[i], starts[i + 1]):
                        c[int(codes[k])] += int(n[k])
                assert of[0] == of[1]
        monkeypatch.undo()
        if held > 200:
            assert np.allclose(whole[0], want, rtol=1e-5, atol=1e-4) and not len(whole[2])
        else:
            assert len(whole[2]) > 100


def test_suffix_tree_takes_little_memory():
    rng = random.Random(37)
    word = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(5000)]
    texts = [" ".join(rng.choices(word, k=n)).encode() for n in [250] * 500 + [250_000]]  # 1 MB in short texts, 2 MB in one
    codes = np.array([c << 48 | 97 for c in range(2)], np.uint64)
    every = np.full(1 << (suffix_tree.REST_BITS - 3), 255, np.uint8)  # no context is decided in the worker
    tree = suffix_tree.Tree(codes >> np.uint64(8), np.zeros(2, np.float32), codes, np.zeros(2, np.float32), every)
    tracemalloc.start()
    tree.scores(texts)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 100 << 20, most
