import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import language_id, mixing, packing, token_counts, toxicity
from siltstone.llm.kneser_ney import CharModel
from tests.compare import same
from tests.llm.helpers import DOCS, ODD, frame, prose, rows, words

public_tokenizers = pytest.importorskip("public_tokenizers")


def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- Kneser-Ney
def test_probabilities_add_up():
    words_ = ["ab", "abc", "ba", "cab", "aab", "b"]
    for shared in (0, 1, 2):
        m = CharModel(2, order=3, shared=shared).fit(words_ * 2, np.array([0] * 6 + [1] * 6), np.array([1, 2, 3, 1, 1, 1] * 2))
        # over all words of up to n characters the probabilities come near 1 and never exceed it
        total, level = np.zeros(2), [""]
        for _ in range(9):
            level = [w + c for w in level for c in "abc"] if level != [""] else list("abc")
            if len(level) > 30000:
                break
            total += np.exp(m.score(level)[0]).sum(0)
        assert (total <= 1 + 1e-6).all() and (total > 0.4).all()


def test_scores_follow_the_class():
    rng = random.Random(1)
    en, de = prose(rng, "en", 400).split(), prose(rng, "de", 400).split()
    m = CharModel(2).fit(en + de, np.array([0] * len(en) + [1] * len(de)), np.ones(len(en) + len(de)))
    s, n = m.score(prose(rng, "en", 50).split())
    assert s[:, 0].sum() > s[:, 1].sum() and (n > 1).all()
    assert np.isfinite(m.score(["中文", ""])[0]).all()


# ---- language
def test_language_by_held_out_rows(spark):
    rng = random.Random(2)
    langs = ["en", "de"] * 60
    docs = frame(spark, rows([prose(rng, x, 40) for x in langs], langs))
    model = language_id.train(docs.where(language_id.fold(F.col("doc_id"), 4) != 2))
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i].held_out for i in held) and all(got[i].lang_pred == langs[i] for i in held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_of_odd_texts(spark):
    rng = random.Random(3)
    train = frame(spark, rows([prose(rng, x, 30) for x in ["en", "de"] * 10], ["en", "de"] * 10))
    model = language_id.train(train)
    got = {r.doc_id: r for r in language_id.predict(frame(spark, rows(ODD)), model).collect()}
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        none = t is None or not any(c.isalpha() for c in t)
        assert (got[i].lang_pred == "und") == none and (got[i].score == 0) == none
    assert got[10].score == got[11].score
    assert language_id.predict(empty(spark), model).count() == 0
    nothing = language_id.train(empty(spark))
    assert {r.lang_pred for r in language_id.predict(train, nothing).collect()} == {"und"}


def test_language_without_letters_is_never_predicted(spark):
    rng = random.Random(11)
    train = frame(spark, rows([prose(rng, "en", 30) for _ in range(20)] + ["123 456"] * 20, ["en"] * 20 + ["digits"] * 20))
    model = language_id.train(train)
    got = language_id.predict(frame(spark, rows([prose(rng, "en", 10), "中文 字", "123"])), model).collect()
    assert [r.lang_pred for r in sorted(got)] == ["en", "en", "und"]
    nothing = language_id.train(frame(spark, rows(["1 2", "3"], ["x", "x"])))
    assert {r.lang_pred for r in language_id.predict(train, nothing).collect()} == {"und"}


def test_language_rejects_what_it_has_not_learned(spark):
    rng = random.Random(12)
    model = language_id.train(frame(spark, rows([prose(rng, x, 60) for x in ["en", "de"] * 80], ["en", "de"] * 80)))
    foreign = ["中文字符 是什么 意思 呢", "Ελληνικά γράμματα εδώ", "qzx wvk jjj xqz kkv wjx"]
    own = [prose(rng, x, 30) for x in ["en", "de"] * 20]
    got = sorted(language_id.predict(frame(spark, rows(foreign + own)), model).collect())
    assert not any(r.accepted for r in got[:3]) and sum(r.accepted for r in got[3:]) >= 38
    assert model.temperature > 0 and np.isfinite(model.usual).all()


def test_language_of_very_long_and_repeated_texts(spark):
    rng = random.Random(13)
    model = language_id.train(frame(spark, rows([prose(rng, x, 40) for x in ["en", "de"] * 20], ["en", "de"] * 20)))
    long_ = prose(rng, "de", 120_000)
    assert len(long_) > 2 * (1 << 18)
    got = language_id.predict(frame(spark, [*rows([long_]), *rows([long_]), *rows(["the there"])]), model).collect()
    assert len(got) == 3 and sorted(r.lang_pred for r in got) == ["de", "de", "en"]
    # by brute force: the sum over all words
    words_ = language_id.letter_words(long_)
    s, n = model.chars.score(words_)
    r = next(r for r in got if r.lang_pred == "de")
    assert abs(r.cross_entropy - (-s[:, model.langs.index("de")].sum() / n.sum())) < 1e-3


def test_language_counts_words_met_once(spark):
    """Beside 120,000 words that repeat, words met once still say what a language looks like."""
    rng = random.Random(10)
    rare = lambda n: " ".join("".join(rng.choice("qxzjvw") for _ in range(9)) for _ in range(n))
    texts = ["the same common words " * 2500 + rare(40) for _ in range(12)] + [prose(rng, "de", 200) for _ in range(12)]
    model = language_id.train(frame(spark, rows(texts, ["en"] * 12 + ["de"] * 12)))
    seen = [w for t in texts[:12] for w in t.split()[10_000:]]
    fit = {w[i : i + 2] for w in seen for i in range(8)}
    s, n = model.chars.score([rare(1) for _ in range(50)])
    assert len(fit) == 36 and (s[:, model.langs.index("en")] / n).mean() > -3


# ---- toxicity
def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    texts = [prose(rng, "en", 30) + (" idiotic scumbag" + rng.choice(["s", "", "ly"]) if i % 3 == 0 else "") for i in range(150)]
    docs = frame(spark, rows(texts))
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(150)] + [(0, 1, None), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.predicted == int(r.doc_id % 3 == 0) for r in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got)


def test_toxicity_of_odd_texts(spark):
    docs = frame(spark, rows(ODD))
    for labels in ([], [(1, 0)], [(i, i % 2) for i in range(len(ODD))]):
        m = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = toxicity.score(docs, m).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert toxicity.score(empty(spark), m).count() == 0


def test_toxicity_counts_rare_words_at_size(spark):
    """Rare words of a large sample count through their stems, those of two documents by themselves too."""
    n, m = 3_000, 400
    common = " ".join(f"{'abcdefghij'[j % 10]}{chr(97 + j // 10 % 26)}{'xyz'[j // 260]}" for j in range(m))
    odd = {0: "zqzqvkrud", 2: "zqzqvkrund", 4: "zqzqvkrid", 6: "twice", 8: "twice"}
    texts = [f"{common} {odd.get(i, 'aax')} {'w' + ''.join('abcdefghij'[int(c)] for c in str(i))}" for i in range(n)]
    sample = spark.createDataFrame([(i, t, int(i % 2 == 0)) for i, t in enumerate(texts)], "doc_id long, text string, toxic int")
    model = toxicity.train(sample, 0.5, 100)
    # a family of rare words counts for words of it that no training text holds, a word of one document alone does not
    assert model.ratios(["zqzqvkred"])[0] > 1 and model.words.counts(["twice"]).tolist() == [[0, 2]] and model.ratios(["twice"])[0] > 1
    assert abs(model.ratios(["unseen"])[0]) < 1e-9
    assert model.words.totals.sum() == sum(len(set(t.split())) for t in texts)


@pytest.mark.parametrize("texts", [[""], ["1 2 3", "..."], ["words", "..."], ["words here", "other words"]])
def test_toxicity_fits_on_batches_without_letters(spark, texts):
    docs = frame(spark, rows(texts * 3))
    for labels in ([0], [1], [0, 1]):
        m = toxicity.fit(docs, spark.createDataFrame([(i, labels[i % len(labels)]) for i in range(len(texts) * 3)], "doc_id long, toxic int"))
        got = toxicity.score(docs, m).collect()
        assert len(got) == len(texts) * 3 and all(0 <= r.score <= 1 for r in got)
        # one class alone rejects nothing
        assert len(labels) > 1 or not any(r.predicted for r in got)


def test_toxicity_of_very_long_and_repeated_texts(spark):
    rng = random.Random(14)
    texts = [prose(rng, "en", 40) + (" scumbag idiotic" if i % 2 else "") for i in range(60)]
    long_ = prose(rng, "en", 120_000) + " scumbag idiotic scumbagly"
    assert len(long_) > 2 * (1 << 18)
    docs = frame(spark, [*rows(texts), *rows([long_]), *rows([texts[0]])])
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] * 2, "doc_id long, toxic int")
    m = toxicity.fit(docs.where("doc_id > 0"), labels)
    got = [r for r in toxicity.score(docs, m).collect() if r.doc_id == 0]
    assert len(got) == 3 and len({r.score for r in got}) == 2
    assert toxicity.Scorer(m).features(long_)[0] > 1


# ---- tokens
def test_token_counts_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(5)
    bits = ["a", "b", " ", "  ", "\n", "\t", "\r", "▁", "é", "ﬁ", "xxxxx", "\x01", "<s>", "中", ".", "**", "\n\n", " \n"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 15))) for _ in range(3000)]
    got = {r.doc_id: r for r in token_counts.count_tokens(frame(spark, rows(texts))).collect()}
    for i, t in enumerate(texts):
        n = len(sp.encode(t)) if t else 0
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 4096), repr(t)
    assert token_counts.count_tokens(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        token_counts.check_vocabulary(["a▁b"])


def test_token_counts_of_very_long_and_repeated_texts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(16)
    long_ = [prose(rng, "en", 60_000), "x" * 300_000, "\x01" + prose(rng, "de", 2000), prose(rng, "en", 30_000).replace(" ", "\n")]
    got = token_counts.count_tokens(frame(spark, [*rows(long_), *rows(long_)])).collect()
    assert len(got) == 8
    for i, t in enumerate(long_):
        assert {(r.n_tokens, r.n_bytes) for r in got if r.doc_id == i} == {(len(sp.encode(t)), len(t.encode()))}


# ---- packing
def test_packing_is_whole_and_gapless(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    texts = ODD + [prose(rng, "en", rng.randint(1, 900)) for _ in range(60)] + ["copy of one"] * 40
    got = packing.pack(frame(spark, rows(texts))).collect()
    ids = {i: np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts)}
    seen = {i: 0 for i in ids}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        seen[r.doc_id] += r.length
    assert seen == {i: len(x) for i, x in ids.items()}
    sequences: dict[int, list] = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    used = []
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        used.append(at)
    assert max(used) <= 1024 and len(used) <= sum(used) / 1024 * 1.05 + 2
    assert packing.pack(empty(spark)).count() == 0


def test_packing_of_odd_long_and_repeated_texts(spark):
    """Ids equal the library's, also beyond plain texts, in texts of several pieces, and where rows repeat."""
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path(packing.RANKS))
    assert encoder.ranks is not None
    rng = random.Random(15)
    bits = ["a", "Zeß", " ", " ", "\n", "don't", "é", "'ll", "12", "٣", "½", "²", ",", "—", "…", "中", "\x01", "\u00a0", "\u2028", "x_y", "<|endoftext|>", "Ünï", "  ", "ſ", "ª"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(4000)] + [t for t in ODD if t]
    for t in texts:
        assert encoder.ids(t) == np.array(tk.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)
    long_ = prose(rng, "de", 60_000)
    got = packing.pack(frame(spark, [*rows([long_, "a b"]), *rows([long_, "other"])])).collect()
    for i, want in ((0, [long_, long_]), (1, ["a b", "other"])):
        ids = [np.array([*tk.encode(t, add_special_tokens=False).ids, 0], "<u4") for t in want]
        own = [r for r in got if r.doc_id == i]
        assert sum(r.length for r in own) == sum(map(len, ids))
        assert sorted(r.ids_crc32 for r in own) == sorted(zlib.crc32(x[j : j + 1024].tobytes()) for x in ids for j in range(0, len(x), 1024))


def test_plan_puts_a_length_into_the_shortest_pack():
    # 7 | 6 take packs of their own; 2 goes to the pack of 6, the shortest, though that of 7 would be left fuller
    assert sorted(packing.plan({7: 1, 6: 1, 2: 1}, 10)) == [(1, [(6, 1), (2, 1)]), (1, [(7, 1)])]


def test_plan_places_every_length():
    rng = random.Random(7)
    for _ in range(30):
        h = {rng.randint(1, 64): rng.randint(1, 500) for _ in range(rng.randint(1, 20))}
        patterns = packing.plan(h, 64)
        placed: dict[int, int] = {}
        for times, parts in patterns:
            assert sum(n * k for n, k in parts) <= 64
            for n, k in parts:
                placed[n] = placed.get(n, 0) + times * k
        assert placed == h


# ---- mixing
def test_mixing_equals_its_sql(spark, sf):
    same(mixing.op2_mixing(spark, sf), mixing.OP2_SQL, sf)


def test_mixing_by_brute_force(spark):
    rng = random.Random(8)
    sources = [rng.choice(["a", "a", "a", "a", "b", "c", "d", None]) for _ in range(len(ODD) + 200)]
    texts = ODD + [prose(rng, "en", rng.randint(0, 30)) for _ in range(200)]
    got = mixing.mix(mixing.sized(frame(spark, rows(texts, None, sources))).select("doc_id", "source", "size")).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts))) and all(r["size"] == len(words(texts[r.doc_id])) for r in got)
    sizes: dict = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    names = sorted(sizes, key=lambda x: (x is None, x))
    weight = {n: 1 + i % 3 for i, n in enumerate(names)}
    total, open_, want = sum(sizes.values()), set(names), {}
    while open_:
        level = (total - sum(want.values())) / sum(weight[n] for n in open_)
        full = {n for n in open_ if weight[n] * level > 3 * sizes[n]}
        if not full:
            want.update({n: weight[n] * level for n in open_})
            break
        want.update({n: 3.0 * sizes[n] for n in full})
        open_ -= full
    for n in names:
        own = [r for r in got if r.source == n]
        assert abs(own[0].target - want[n]) < 1e-6 and own[0].source_size == sizes[n]
        assert abs(sum(r.taken for r in own) - want[n]) <= 1 and all(0 <= r.taken <= 3 * r["size"] for r in own)
    assert mixing.mix(mixing.sized(empty(spark))).count() == 0
    again = mixing.mix(mixing.sized(frame(spark, rows(texts, None, sources), 5)).select("doc_id", "source", "size")).collect()
    assert {(r.doc_id, r.taken, r.position) for r in got} == {(r.doc_id, r.taken, r.position) for r in again}


def test_the_mix_repeats_and_orders(spark):
    docs = frame(spark, rows(["a b c d"] * 30 + ["e f"] * 3, None, ["x"] * 30 + ["y"] * 3))
    got = mixing.mixed(docs).collect()
    n = {i: 0 for i in range(33)}
    for r in got:
        n[r.doc_id] += 1
    assert all(n[i] == 3 for i in range(30, 33)) and all(v <= 3 for v in n.values()) and list(got[0].asDict()) == docs.columns
