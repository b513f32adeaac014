"""The training-data operators against brute force, round trips and their documented edge cases."""

from __future__ import annotations

import itertools
import random
import time
import unicodedata

import numpy as np
import pandas as pd
import pytest

from pulsemill.llm import bpe, incremental, language, leaks, looks, minhash, neardup, sentences, together
from pulsemill.llm.bktree import Forest
from pulsemill.llm.machine import Machine
from pulsemill.llm.textform import consistent, folded, key_form
from pulsemill.sources.tables import table

TEXTS = "id long, text string, h string, form string"


def _clash(rows):
    return [(*r, "clash", "clash") for r in rows]


# 5: one consistent form


def test_consistent_form():
    assert consistent(None) is None and consistent("") == ""
    assert consistent("Ｂ­ТC up ﬁrst​") == "BTC up first"
    assert consistent("café") == consistent("café") and consistent("ﾊﾟ") == consistent("パ")
    assert consistent("ё") == consistent("ë")
    for a, b in (("a", "A"), ("e", "é"), ("1", "2"), ("a b", "ab")):
        assert consistent(a) != consistent(b)
    assert folded("STRASSE") == folded("straße")
    for s in ("Ｂ­ТC up ﬁrst", "й й", "가", "½"):
        assert consistent(consistent(s)) == consistent(s)


def test_look_alike_pairs(spark):
    rows = [(1, "Buy now"), (2, "Buy now"), (3, "Вuy now"), (4, "buy now"), (5, None), (None, "Buy now"), (6, ""), (7, "​"), (2, "Buy now"), (8, "Buy now")]
    got = {tuple(r) for r in looks.look_alike_pairs(spark.createDataFrame(_clash(rows), TEXTS)).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (2, 8), (3, 8), (6, 7)}
    assert looks.look_alike_pairs(spark.createDataFrame([], TEXTS)).count() == 0
    forms = looks.with_form(spark.createDataFrame(_clash(rows), TEXTS), fold_case=True)
    assert forms.columns == ["id", "text", "h", "form"] and {r["form"] for r in forms.collect()} == {"buy now", None, ""}


def test_the_form_of_a_letter_does_not_depend_on_its_neighbours():
    letters = [c for c in map(chr, range(0xC0, 0x2000)) if c.isalpha() and unicodedata.category(c) != "Mn"]
    r = random.Random(2)
    for c in ["ό", "ӓ", "ќ", "ѐ", "ё", "й", *r.sample(letters, 400)]:
        if unicodedata.normalize("NFD", c)[0] < "ᄀ" or c > "ᇿ":  # conjoining jamo do join
            for d in ("α", "а", "x", "é"):
                assert consistent(c + d) == consistent(c) + consistent(d), (c, d)
    assert consistent("ΌRΕ") == consistent("ÓRE") and consistent("ꓐꓔꓚ Ꮯօⲟ") == "BTC Coo"


def test_look_alike_classes(spark):
    rows = [(1, "Buy now"), (2, "Вuy\u00a0now"), (3, "buy now"), (4, "Buy now"), (5, None), (None, "Buy now"), (6, ""), (4, "Buy now")]
    got = {tuple(r) for r in looks.look_alike_classes(spark.createDataFrame(_clash(rows), TEXTS)).collect()}
    assert got == {(1, 1, 2), (2, 1, 2), (4, 1, 2), (3, 3, 1), (6, 6, 1)}
    assert looks.look_alike_classes(spark.createDataFrame([], TEXTS)).count() == 0


# 7 and 6: near duplicates


def test_bk_forest_equals_a_scan():
    r = random.Random(1)
    words = [r.getrandbits(128) for _ in range(60)]
    words += [w ^ (1 << r.randrange(128)) ^ (1 << r.randrange(128)) for w in words] + words[:5]
    r.shuffle(words)
    group = sorted(r.randrange(4) for _ in words)
    rows = np.array([(w >> 64, w & (2**64 - 1)) for w in words], np.uint64)
    near = lambda i, j, radius: (words[i] ^ words[j]).bit_count() <= radius
    one = Forest(np.zeros(len(words), np.int64), rows)
    for radius in (0, 3, 42):
        got = [tuple(sorted(p)) for x, y, _ in Forest(np.array(group), rows).pairs(radius) for p in zip(x.tolist(), y.tolist())]
        assert sorted(got) == [(i, j) for i, j in itertools.combinations(range(len(words)), 2) if group[i] == group[j] and near(i, j, radius)]
        got = [p for x, y, _ in one.within(rows[:40], radius) for p in zip(x.tolist(), y.tolist())]
        assert sorted(got) == [(i, j) for i in range(len(words)) for j in range(40) if near(i, j, radius)]
    assert list(Forest(np.empty(0, np.int64), np.empty((0, 2), np.uint64)).pairs(3)) == [] == list(Forest(np.empty(0, np.int64), np.empty((0, 2), np.uint64)).within(rows, 3))
    visits = sum(v for *_, v in one.within(rows, 3))
    assert visits < 0.5 * len(words) ** 2  # a narrow radius prunes


def test_shards_are_numbered_across_batches():
    r = random.Random(3)
    keys = sorted(r.randrange(12) if r.random() < 0.5 else r.randrange(12, 60) for _ in range(100))
    rows = list(zip(keys, range(100)))
    want, seen = [], {}
    for k, i in rows:
        if keys.count(k) > 1:
            want.append((k, seen.get(k, 0) // 3, i))
        seen[k] = seen.get(k, 0) + 1
    for size in (1, 2, 7, 100):
        parts = (pd.DataFrame(rows[i : i + size], columns=["key", "rep"]) for i in range(0, 100, size))
        got = [tuple(x) for f in neardup._number(3)(parts) for x in f.itertuples(index=False)]
        assert got == want


def _variants(n: int, seed: int) -> list[tuple[int, str]]:
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    out, i = [], 0
    for _ in range(n):
        base = "".join(r.choice(letters) for _ in range(r.choice((45, 120, 400))))
        out.append((i := i + 1, base))
        for _ in range(r.randrange(4)):
            s = list(base)
            for _ in range(r.randrange(5)):
                s[r.randrange(len(s))] = r.choice(letters)
            out.append((i := i + 1, "".join(s).upper() + r.choice(("", " !", "​"))))
    return out


def _brute(rows):
    forms = {i: key_form(t) for i, t in rows if i is not None and t is not None and len(key_form(t)) >= 40}
    return {(a, b) for a, b in itertools.combinations(sorted(forms), 2) if minhash.alike(forms[a], forms[b])}


@pytest.mark.parametrize("shard", [2000, 3])
def test_alike_pairs(spark, shard):
    rows = _variants(40, 2)
    want = _brute(rows)
    rows += [(900, None), (901, ""), (902, "short"), (None, rows[0][1]), rows[3]]
    got = {tuple(r) for r in neardup.alike_pairs(spark.createDataFrame(_clash(rows), TEXTS), shard=shard).collect()}
    assert not got - want and len(got) >= 0.98 * len(want)


def test_hot_shard_is_searched_in_chunks(spark):
    r = random.Random(5)
    base = "".join(r.choice("abcdefghij") for _ in range(300))
    rows = [(i, base[: 5 * i] + f"{i:03d}" + base[5 * i :]) for i in range(1, 41)]
    links = neardup.candidate_links(neardup.classes(neardup.fingerprints(spark.createDataFrame(_clash(rows), TEXTS))), shard=4)
    assert links.count() == 40 * 39 // 2


def test_alike_groups_and_nothing(spark):
    none = spark.createDataFrame([], TEXTS)
    assert neardup.alike_pairs(none).count() == 0 and neardup.alike_groups(none).count() == 0
    long = "x y z " * 30_000
    rows = [(1, long), (2, long + "!"), (3, "completely different words stand in this text, none of them shared")]
    got = {(r["id"], r["class_id"], r["links"]) for r in neardup.alike_groups(spark.createDataFrame(_clash(rows), TEXTS)).collect()}
    assert got == {(1, 1, 0), (2, 1, 0), (3, 3, 0)}


def test_batches_against_the_index(spark, tmp_path):
    rows = _variants(30, 9)
    r = random.Random(4)
    old = [x for x in rows if r.random() < 0.6]
    new = [x for x in rows if x not in old]
    frame = lambda part: spark.createDataFrame(_clash(part), TEXTS)
    pairs = _brute(rows)
    want = {(min(a for a, b in pairs if b == i), i) for i, _ in new if any(b == i for _, b in pairs)}
    for shard in (2000, 1):
        path = f"{tmp_path}/index{shard}"
        index = incremental.AcceptedIndex.create(spark, path, 3, 2, shard)
        index.append(incremental.printed(frame(old[::2])))
        index.append(incremental.printed(frame(old[1::2])))
        for name in index.tables.values():  # a session that knows nothing of it
            spark.sql(f"drop table {name}")
        index = incremental.AcceptedIndex.open(spark, path)
        found, _ = incremental.repeats(index, frame([*new, (None, "x" * 50), (999, None)]))
        assert {tuple(x) for x in found.collect()} == want
        if shard == 1:
            numbers = {}
            for row in index.read("hot").collect():
                numbers.setdefault(row["key"], []).append(row["chunk"])
            assert numbers and all(sorted(v) == list(range(1, len(v) + 1)) for v in numbers.values())
            assert {r["key"]: r["n"] for r in index._heat().collect()} == {k: len(v) for k, v in numbers.items()}
        plan = index.probe(incremental._signed(incremental._classes(incremental.printed(frame(new))), index.scheme))._jdf.queryExecution().toString()
        assert "Bucketed: true" in plan and "slot" in plan


def test_an_append_that_never_ended_does_not_count(spark, tmp_path):
    frame = lambda part: spark.createDataFrame(_clash(part), TEXTS)
    a, b = "a quick brown fox jumps over the lazy dog and runs away" * 2, "some other words make up this second text, which is long enough"
    index = incremental.AcceptedIndex.create(spark, f"{tmp_path}/index", 2, 2)
    index.append(incremental.printed(frame([(1, a)])))
    index.append(incremental.printed(frame([(2, b)])))
    index._save(writing=True)  # as if the second had died
    index = incremental.AcceptedIndex.open(spark, f"{tmp_path}/index")
    found, _ = incremental.repeats(index, frame([(3, a), (4, b)]))
    assert {tuple(x) for x in found.collect()} == {(1, 3)}
    with pytest.raises(ValueError):
        incremental.AcceptedIndex.create(spark, f"{tmp_path}/index")
    with pytest.raises(ValueError):
        incremental.AcceptedIndex.open(spark, f"{tmp_path}/none")


def test_accepted_records_are_found_by_the_next_batch(spark, tmp_path):
    frame = lambda part: spark.createDataFrame(_clash(part), TEXTS)
    a, b = "a quick brown fox jumps over the lazy dog and runs away" * 2, "some other words make up this second text, which is long enough"
    index = incremental.AcceptedIndex.create(spark, f"{tmp_path}/index", 2, 2)
    assert incremental.take_batch(index, frame([(1, a)])).count() == 0
    assert {tuple(x) for x in incremental.take_batch(index, frame([(2, a + "!"), (3, b), (4, b)])).collect()} == {(1, 2), (3, 4)}
    assert {tuple(x) for x in incremental.take_batch(index, frame([(5, b.upper())])).collect()} == {(3, 5)}
    assert incremental.take_batch(index, frame([])).count() == 0
    assert {r["rep"] for r in index.read("forms").collect()} == {1, 3}


def test_unprocessed_records_join_the_index(spark, tmp_path):
    a, b = "a quick brown fox jumps over the lazy dog and runs away" * 2, "some other words make up this second text, which is long enough"
    rows = [(1, a, "2024-01-01"), (2, a + "!", None), (3, b, None), (4, b, None)]
    messages = spark.createDataFrame(rows, "id long, text string, at string").selectExpr("*", "cast(at as timestamp_ntz) l1_processed_at")
    assert {tuple(x) for x in incremental.unprocessed_repeats(messages, f"{tmp_path}/index").collect()} == {(1, 2), (3, 4)}
    assert {r["rep"] for r in incremental.AcceptedIndex.open(spark, f"{tmp_path}/index").read("forms").collect()} == {1, 3}


# 3: items that appear together

BASKETS = "msg_id long, entity string, b string, i string"


def test_items_with_most_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(together, "HOT", 0.2)
    rows = [(i, "hot") for i in range(60)] + [(i, f"x{i % 7}") for i in range(50)] + [(0, "once")]
    got = {tuple(r)[:3] for r in together.pair_counts(spark.createDataFrame(rows, "msg_id long, entity string"), least=2).collect()}
    assert got == {("hot", f"x{k}", len(range(k, 50, 7))) for k in range(7)}


@pytest.mark.parametrize(("block", "least"), [(64, 1), (3, 1), (3, 4)])
def test_pair_counts(spark, block, least):
    r = random.Random(8)
    rows = [(r.choice([None, *range(40)]), r.choice([None, *"abcdefghijkl"])) for _ in range(400)] + [(77, c) for c in "abcdefghijklmnop"]
    held = {(m, e) for m, e in rows if m is not None and e is not None}
    by: dict = {}
    for m, e in held:
        by.setdefault(m, set()).add(e)
    n_of = {e: sum(e in s for s in by.values()) for _, e in held}
    want = {}
    for s in by.values():
        for p in itertools.combinations(sorted(s), 2):
            want[p] = want.get(p, 0) + 1
    got = together.pair_counts(spark.createDataFrame(_clash(rows), BASKETS), least=least, block=block).collect()
    assert {tuple(x) for x in got} == {(a, b, c, n_of[a], n_of[b], len(by)) for (a, b), c in want.items() if c >= least}
    assert together.pair_counts(spark.createDataFrame([], BASKETS)).count() == 0


def test_scores_have_pairs_of_one_message(spark, tmp_path):
    from pulsemill.llm.queries import p3_scores

    rows = [(1, "a"), (1, "b"), (2, "a"), (2, "c"), (3, "a"), (3, "c"), (3, "c"), (4, "d")]
    spark.createDataFrame(_clash(rows), BASKETS).write.parquet(f"{tmp_path}/entity_mentions.parquet")
    got = {(r["item_a"], r["item_b"]): (r["c"], r["n_a"], r["n_b"], r["n"], r["lift"]) for r in p3_scores(spark, str(tmp_path)).collect()}
    assert got == {("a", "b"): (1, 3, 1, 4, 1.333333), ("a", "c"): (2, 3, 2, 4, 1.333333)}


# 8: tokens


def test_rank_queue_gives_the_lowest_first():
    q, r = bpe.RankQueue(50_000), random.Random(2)
    put = [r.randrange(50_000) for _ in range(500)]
    for k in put:
        q.put(k, (k,))
    got = []
    while (k := q.take()[0]) >= 0:
        got.append(k)
    assert got == sorted(set(put))


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_CHARS", 5000)
    with open(bpe.TOKENIZER, "rb") as f:
        encoder = bpe.Encoder(f.read())
    texts = [f"wide   gap {i} " * 50 for i in range(20)]
    one = [encoder.encode([t])[0].tolist() for t in texts]
    assert encoder.chars <= 5000 + 2 * 50 * 20
    assert one == [encoder.encode([t])[0].tolist() for t in texts]


def test_ids_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    r = random.Random(6)
    al = " \n\ta1é漢'．s.​_²①x🚀"
    texts = ["".join(r.choice(al) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 5001, "=" * 777, "ab" * 30_000, "漢" * 9000, "<|endoftext|>", "   leading", "don't you'll"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*texts, None, ""])] + [(None, "x", ""), (0, texts[0], "")], "doc_id long, text string, ids string")
    got = bpe.encode_corpus(docs).collect()
    t = tokenizers.Tokenizer.from_file(bpe.TOKENIZER)
    t.encode_special_tokens = True
    want = {i: e.ids for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False))}
    assert len(got) == len(texts) + 4
    for row in got:
        if row["doc_id"] is not None:
            assert row["ids"] == want.get(row["doc_id"], [])
    assert bpe.encode_corpus(docs.limit(0)).count() == 0


# 9: leaks


def _item(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(n))


def test_leaks_equal_brute_force(spark):
    r = random.Random(11)
    items = [(i, _item(r, 60), "en") for i in range(8)] + [(8, "".join(chr(0x4E00 + r.randrange(900)) for _ in range(120)), "zh"), (9, None, "en"), (10, "too short", None)]
    docs = []
    for i in range(120):
        k = r.randrange(9)
        w, join = (list(items[k][1]), "") if k == 8 else (items[k][1].split(), " ")
        a, n = r.randrange(len(w)), r.randrange(len(w))
        part = w[a : a + n]
        for _ in range(r.randrange(3)):
            if part:
                part[r.randrange(len(part))] = "另" if k == 8 else "zzz"
        docs.append((i, _item(r, 20) + " " + join.join(part).upper() + ", " + _item(r, 20)))
    docs += [(200, None), (201, ""), (None, items[0][1]), docs[0]]
    want = set()
    for d, text in docs:
        if d is None or text is None:
            continue
        form = key_form(text)
        for i, t, lang in items:
            u = leaks.units(t, lang == "zh")
            run = 16 if lang == "zh" else 8
            held = [False] * len(u)
            for a in range(len(u) - run + 1):
                if "".join(u[a : a + run]) in form:
                    held[a : a + run] = [True] * run
            if len(u) >= run and sum(held) >= 0.4 * len(u):
                want.add((d, i))
    corpus = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, lang string, doc_id int")
    assert want
    for block in (leaks.BLOCK_CHARS, 500):
        assert {tuple(x) for x in leaks.leaks(corpus, bench, block).collect()} == want
    assert leaks.leaks(corpus.limit(0), bench).count() == 0 and leaks.leaks(corpus, bench.limit(0)).count() == 0


def test_leaks_of_text_that_repeats_itself():
    r = random.Random(4)
    words = ["ha", "haha", "no"]
    for lang in ("en", "zh"):
        items = [" ".join(r.choice(words) for _ in range(40)) for _ in range(4)]
        docs = [" ".join(r.choice(words) for _ in range(60)) + " " + items[r.randrange(4)][r.randrange(60) :] for _ in range(40)]
        want = set()
        run = 16 if lang == "zh" else 8
        for i, t in enumerate(items):
            u = leaks.units(t, lang == "zh")
            for d, form in enumerate(map(key_form, docs)):
                held = [False] * len(u)
                for a in range(len(u) - run + 1):
                    if "".join(u[a : a + run]) in form:
                        held[a : a + run] = [True] * run
                if sum(held) >= 0.4 * len(u):
                    want.add((d, i))
        assert want and set(leaks.search(leaks.prepare(list(range(4)), items, [lang] * 4), list(map(key_form, docs)))) == want
    began = time.time()
    assert leaks.search(leaks.prepare([0], ["a" * 600], ["zh"]), ["a" * 600_000]) == [(0, 0)]
    assert time.time() - began < 60


def test_long_items_are_blocks_of_their_own(spark):
    items = spark.createDataFrame([(i, "x" * n) for i, n in enumerate((5000, 700, 400, 20, 20, 20))], "item_id long, text string")
    parts = [sorted(r["item_id"] for r in p.collect()) for p in leaks._blocks(items, 1000)]
    assert parts[0] == [0] and sorted(x for p in parts for x in p) == list(range(6)) and [1] in parts or [1, 2] in parts


# 1: languages


def test_the_sample_is_bounded_at_any_size():
    for n in (1, 699, 700, 701, 10**6, 10**13):
        share = (language._highest(700, n) + 2**63) / 2**64
        assert share * n <= 700.001 or n <= 700 and share <= 1


def test_segments_can_be_found_again(spark):
    model = language.Model(["de", "en"], np.zeros((language.BUCKETS, 2), np.float32))
    texts = [("Ｈello wörld， the ﬁne day", 1), ("", 2), (None, 3), ("x", None), ("$BTC 42", 4)]
    rows = spark.createDataFrame([(i, t, "clash") for t, i in texts], "id long, text string, lang string")
    got = language.message_segments(rows, model, None).collect()
    one = next(r for r in got if r["msg_id"] == 1)
    assert texts[0][0][one["start_pos"] : one["end_pos"]] == texts[0][0] and one["counts"] and 0 < one["confidence"] <= 1
    assert {r["msg_id"] for r in got if r["lang"] is None} == {2, 3, 4} and len(got) == 4


def test_labels(spark):
    rows = [("zh-CN", "zh"), (" ZH ", "zh"), ("eng", "en"), ("pt_BR", "pt"), ("und", None), ("", None), (None, None), ("unknown", None), ("xx", None)]
    got = spark.createDataFrame(rows, "lang string, want string").select("want", language.label_code("lang").alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_languages_of_held_out_messages(spark, small):
    messages, labels, vocab = (table(spark, small.replace("0.001", "0.01"), n) for n in ("normalized_messages", "message_labels", "vocab"))
    names = language.vocabulary_names(vocab)
    model = language.fit_on(messages, labels, names, sample=120)
    sentences_of = {
        "en": "several hidden brokers questioned the founders under pressure this morning",
        "es": "los compradores pequeños absorbieron los contratos viejos esta mañana",
        "pt": "os vendedores pequenos fecharam uns contratos novos nesta manhã",
        "de": "die vorsichtigen Händler prüften gestern die alten Verträge",
        "ru": "медленные кошельки снова обошли старые фонды",
        "zh": "听说长期的流量要反弹了，不少手续选择试探",
        "ja": "今朝、弱い流動性がチャートを開いた",
        "ko": "지갑들은 작은 주문들을 무시했다 오늘 아침",
    }
    rows = [(i, t) for i, t in enumerate(sentences_of.values())]
    mixed = sentences_of["en"] + "\n" + sentences_of["es"]
    rows += [(100, mixed), (101, None), (102, ""), (103, "$BTC 🚀 https://radar.example/x"), (None, mixed), (104, "b" * 100_000), (105, "кoшeльки снова обошли стaрыe фонды")]
    got = {}
    for r in language.message_languages(spark.createDataFrame(_clash(rows), TEXTS), model, names).orderBy("msg_id", "segment").collect():
        got.setdefault(r["msg_id"], []).append(r["lang"])
        assert r["confidence"] is None or 0 < r["confidence"] <= 1
    assert [got[i] for i in range(len(sentences_of))] == [[x] for x in sentences_of]
    assert got[100] == ["en", "es"] and got[101] == got[102] == got[103] == [None] and got[105] == ["ru"] and None not in got
    none = messages.limit(0)
    assert language.message_languages(none, model, names).count() == 0
    assert language.wrong_or_mixed(none, labels.limit(0), vocab.limit(0)).count() == 0


# 10: sentences


def _cut(text):
    _, a, b = sentences.spans([text])
    return [text[x:y] for x, y in zip(a.tolist(), b.tolist())]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("One. Two! Three?!", ["One.", "Two!", "Three?!"]),
        ("Dr. Velmor paid $4.50 in the U.S. on Jan. 2024. Then he left.", ["Dr. Velmor paid $4.50 in the U.S. on Jan. 2024.", "Then he left."]),
        ("He works in the U.S. Most do.", ["He works in the U.S.", "Most do."]),
        ("See https://a.example/x.y?z=1. Next one.", ["See https://a.example/x.y?z=1.", "Next one."]),
        ('"One. Two," the desk wrote. Three.', ['"One. Two," the desk wrote.', "Three."]),
        ("“一句。两句！”群主这样写道。三句。", ["“一句。两句！”群主这样写道。", "三句。"]),
        ("A vault (One. Two.) stayed put. (Three.) Four.", ["A vault (One. Two.) stayed put.", "(Three.)", "Four."]),
        ("They moved... and left. They moved... Others left……，跟上。", ["They moved... and left.", "They moved...", "Others left……，跟上。"]),
        ("a wrapped\nline goes on\n\nnext", ["a wrapped\nline goes on", "next"]),
        ("1. one 2.5\n2. two\n- three\n• four", ["1. one 2.5", "2. two", "- three", "• four"]),
        ("[12:19] @a: first. Second\n[12:20] @b: third 🚀\r\n[12:21] @c: fourth. <|x|>", ["[12:19] @a: first.", "Second", "[12:20] @b: third 🚀", "[12:21] @c: fourth. <|x|>"]),
        ("## Head\n\nBody.Missing space. End", ["## Head", "Body.", "Missing space.", "End"]),
        ("ราคาเก่า ตลาดใหม่ราว 42.5 เหรียญ ผู้ซื้อ", ["ราคาเก่า", "ตลาดใหม่ราว 42.5 เหรียญ", "ผู้ซื้อ"]),
        ("am 16. März kam er. Nr. 31 blieb.", ["am 16. März kam er.", "Nr. 31 blieb."]),
        ("", []),
        (" \n　 ", []),
        ("\x00\x01\n\nx", ["x"]),
    ],
)
def test_sentences(text, want):
    assert _cut(text) == want


def test_list_markers_of_any_length():
    items = [f"{k}. item {k}" for k in (99, 100, 101)]
    assert _cut("\n".join(items)) == items
    assert _cut("Lead.\n\n3738. Because it moved. Next\n3739. more") == ["Lead.", "3738. Because it moved.", "Next", "3739. more"]


def test_paragraphs_of_nothing_visible():
    for part in ("\u200b" * 3, "\u200b" * 40, "\x01\u200b \u2060" * 20):
        assert _cut(f"{part}\n\nOne.\n\n{part}") == ["One."] and _cut(part) == []
    assert _cut("\u200b" * 40 + "x\n\ny") == ["\u200b" * 40 + "x", "y"]


def test_transducer_chunks_do_not_matter():
    r = np.random.default_rng(3)
    for n in (1, 7, 5000):
        s = r.integers(0, 8, n).astype(np.uint8)
        state, want = sentences.BETWEEN, []
        for x in s:
            want.append(int(state in sentences._BEGINS.get(int(x), ())))
            state = sentences._NEXT[int(x)][state]
        for chunk in (1, 3, 256):
            assert sentences.transduce(s, chunk).tolist() == want


def test_machines_in_chunks_equal_one_walk(monkeypatch):
    r = np.random.default_rng(1)
    for states in (5, 60):
        to = r.integers(0, states, (states, 6))
        to[:, 0] = 3  # a symbol that resets
        m = Machine(0, 6, lambda state, symbol, to=to: int(to[state, symbol]))
        for n, share in ((0, 0.5), (1, 0.5), (700, 0.2), (700, 0.001), (5000, 0.0)):
            s = np.where(r.random(n) < share, 0, r.integers(1, 6, n))
            for backward in (False, True):
                state, want = 0, []
                for x in s[::-1] if backward else s:
                    want.append(state := int(to[state, x]))
                for chunk in (7, 256):
                    got = [m.states[i] for i in m.run(s, backward, chunk)]
                    assert got == (want[::-1] if backward else want)
    # the rules on any text, however it is cut
    signs = "aB.c 1.,!?…。”“\"'()[]«»\n -Dr. Prof. e.g. 3. März「」ก　\n\n"
    texts = ["".join(signs[i] for i in r.integers(0, len(signs), 400)) for _ in range(20)]
    whole = [x.tolist() for x in sentences.spans(texts)]
    monkeypatch.setattr(Machine.run, "__defaults__", (False, 5))
    assert [x.tolist() for x in sentences.spans(texts)] == whole
    each = [(k, a, b) for k, x in enumerate(texts) for _, a, b in zip(*(y.tolist() for y in sentences.spans([x])))]
    assert each == list(zip(*whole))


def test_long_documents_are_cut_at_blank_lines(spark):
    text = "Hello there. And you.\n\n  \n- one\n- two (a. b) c.\n\n“Hi. You” said. 3.5 ok\n\n" * 30
    rows = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "no blank line. " * 20, 0), (4, "", 0)], "doc_id long, text string, off int")
    whole = sorted(map(tuple, sentences.sentences(rows).collect()))
    assert sorted(map(tuple, sentences.sentences(rows, piece=70).collect())) == whole and len(whole) > 100


def test_sentences_of_a_table(spark):
    long = "A sentence stands here. " * 40_000
    docs = spark.createDataFrame([(1, "Abc. Def.", 0), (2, None, 0), (3, "", 0), (None, "x", 0), (4, long, 0), (1, "Abc. Def.", 0)], "doc_id long, text string, end_pos int")
    got = sentences.sentences(docs).collect()
    assert sorted(tuple(r) for r in got if r["doc_id"] == 1) == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9)]
    assert sum(r["doc_id"] == 4 for r in got) == 40_000 and [tuple(r) for r in got if r["doc_id"] is None] == [(None, 0, 1)]
    assert sentences.sentences(docs.limit(0)).count() == 0
