"""Language, quality, tokens, packing, licences: against brute force and in the corner cases."""

import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brute import PlainKneserNey
from millrace.llm import bpe, language_id, licences, packing, quality_fm

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string, lang string, score string"


def documents(spark, rows):
    return spark.createDataFrame(rows, DOCS)


EDGE = [(1, None, None, "x"), (2, "", "en", "x"), (3, " \n\t", None, None), (4, "12 !!", "en", "x"), (5, "word " * 30000, "en", "x"), (6, "the the", "en", "x"), (6, "the the", "en", "x"), (None, "tail", None, None)]


@pytest.fixture(scope="module")
def languages(spark):
    rng = np.random.default_rng(0)
    parts = {"aa": ["ka", "lo", "mi", "tun"], "bb": ["schr", "ung", "ei", "zü"], "cc": ["qua", "iño", "cué", "lla"]}
    rows = []
    for i in range(240):
        lang = sorted(parts)[i % 3]
        text = " ".join("".join(rng.choice(parts[lang], rng.integers(1, 4))) for _ in range(40))
        rows.append((100 + i, text, lang, "x"))
    return rows


def test_languages_are_told_apart_on_held_out_rows(spark, languages):
    models = language_id.fit(documents(spark, languages[:180]))
    got = {r.doc_id: r for r in language_id.identify(documents(spark, languages[180:]), models).collect()}
    assert all(got[i].lang_pred == lang and not got[i].rejected and 0.5 < got[i].score <= 1 for i, _, lang, _ in languages[180:])
    odd = language_id.identify(documents(spark, [(1, "漢字仮名交じり文" * 20, None, "x")]), models).first()
    assert odd.rejected


@pytest.mark.parametrize("labelled", [1, 2, 6])
def test_rare_languages_reject_too(spark, languages, labelled):
    rng = np.random.default_rng(8)
    some = lambda: " ".join("".join(rng.choice(["και", "του", "στη", "νερ", "ολο"], rng.integers(1, 4))) for _ in range(60))
    texts = [some() for _ in range(labelled + 10)]
    junk = ["".join(rng.permutation(list(t))) for t in texts[:10]] + ["漢字仮名交じり文" * 20]
    ids = iter(range(900, 9999))
    rows = languages + [(next(ids), t, "el", "x") for t in texts[:labelled]]
    models = language_id.fit(documents(spark, rows))
    while "el" not in models.languages:  # its only documents were held back
        rows = languages + [(next(ids), t, "el", "x") for t in texts[:labelled]]
        models = language_id.fit(documents(spark, rows))
    assert np.isfinite(models.limits[0]).all() and np.isfinite(models.limits[1]).all()
    units = language_id.Units()
    own, bad = models.labels(units, texts[labelled:]), models.labels(units, junk)
    assert own["lang_pred"] == ["el"] * 10 and not any(own["rejected"])
    assert "el" in bad["lang_pred"] and all(bad["rejected"])


def test_language_probabilities_sum_to_one(spark, languages):
    keys, of, _ = language_id.Units()([t for _, t, lang, _ in languages if lang == "aa"][:20])
    k, c = np.unique(keys, return_counts=True)
    model = language_id.KneserNey(k, c, alphabet=len(np.unique(k & np.uint64(0xFFFF))) + 1)
    letters = np.unique(k & np.uint64(0xFFFF))
    context = k[5] >> np.uint64(16)
    p = model.probability(4, (context << np.uint64(16)) | letters)
    assert 0.9 < p.sum() <= 1 + 1e-9  # what is missing belongs to the unseen letter


def test_scores_do_not_depend_on_blocks(spark, languages, monkeypatch):
    models = language_id.fit(documents(spark, languages))
    texts = [t for _, t, _, _ in languages[:9]]
    units = language_id.Units()
    whole, _, _ = models.entropies(units, ["\n".join(texts)] + texts)
    single = [models.entropies(units, [t])[0][0] for t in texts]
    assert np.allclose(whole[1:], single)


def test_language_edge_cases(spark, languages):
    models = language_id.fit(documents(spark, languages))
    got = language_id.identify(documents(spark, EDGE), models).collect()
    assert len(got) == len(EDGE) and got[0].__fields__[:3] == ["doc_id", "text", "lang"]
    by = {r.doc_id: r for r in got}
    for i in (1, 2, 3, 4):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert by[5].lang_pred in ("aa", "bb", "cc")
    assert language_id.identify(documents(spark, []), models).count() == 0
    nothing = language_id.fit(documents(spark, []))
    assert language_id.identify(documents(spark, EDGE), nothing).first().lang_pred == "und"


def test_quality_is_learned_and_scored_in_linear_time(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdeiou"), 5))
    rows = [(i, " ".join(word() + ("***" if i % 4 == 0 else "") for _ in range(30)), None, "x") for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(160)] + [(3, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality_fm.fit(documents(spark, rows), labels)
    got = {r.doc_id: r for r in quality_fm.score(documents(spark, rows), model).collect()}
    assert all(got[i].predicted == int(i % 4 != 0) for i in range(160, 240))
    # The identity, against all pairs written out.
    index, value, starts = quality_fm.Features().many([rows[0][1]])
    y, _ = model.margins(index, value, starts)
    v = model.factors[index] * value[:, None]
    pairs = sum(v[i] @ v[j] for i in range(len(v)) for j in range(i))
    assert np.isclose(y[0], model.bias + model.linear[index] @ value + pairs)


def test_quality_training_follows_the_slope():
    """One step of the fit against numerical derivatives of the loss, and the loss falls."""
    rng = np.random.default_rng(3)
    f = quality_fm.Features()
    texts = [f.one(" ".join(rng.choice(["good", "fine", "bad", "***", "x1"], 6))) for _ in range(24)]
    labels = rng.integers(0, 2, 24).astype(float)

    def loss(model):
        index, value = (np.concatenate([t[j] for t in texts]) for j in (0, 1))
        y, _ = model.margins(index, value, np.cumsum([0, *(len(t[0]) for t in texts)])[:-1])
        return float(np.mean(np.log1p(np.exp(-np.where(labels > 0, y, -y)))))

    step = 1e-6  # the first step of Adam moves each weight by the rate against the sign of its slope
    before = quality_fm.FactorisationMachine.fit(texts, labels, rank=2, epochs=0, size=24, decay=0)
    after = quality_fm.FactorisationMachine.fit(texts, labels, rank=2, epochs=1, size=24, rate=step, decay=0)
    for i in np.unique(texts[0][0])[:12]:
        for place in [(before.linear, after.linear, (i,)), (before.factors, after.factors, (i, 0)), (before.factors, after.factors, (i, 1))]:
            was, now, at = place
            kept = was[at]
            was[at] = kept + 1e-4
            up = loss(before)
            was[at] = kept - 1e-4
            slope = (up - loss(before)) / 2e-4
            was[at] = kept
            if abs(slope) > 1e-5:
                assert np.sign(now[at] - kept) == -np.sign(slope)
    fitted = quality_fm.FactorisationMachine.fit(texts, labels, rank=2, epochs=30, size=8)
    assert loss(fitted) < 0.7 * loss(before)


def test_quality_learns_a_key_once(spark):
    rows = [(1, "good text", None, "x")] * 40 + [(2, "bad *** text", None, "x"), (1, "another text of that key", None, "x")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    once = quality_fm.fit(documents(spark, [(1, "another text of that key", None, "x"), (2, "bad *** text", None, "x")]), labels)
    assert np.allclose(quality_fm.fit(documents(spark, rows), labels).linear, once.linear)


def test_quality_edge_cases(spark):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0)], "doc_id bigint, quality int, toxic int")
    model = quality_fm.fit(documents(spark, EDGE), labels)
    got = quality_fm.score(documents(spark, EDGE), model).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in got if r.doc_id in (1, 2)][0] == [r.score for r in got if r.doc_id in (1, 2)][1]
    assert quality_fm.score(documents(spark, []), model).count() == 0
    assert quality_fm.score(documents(spark, EDGE), quality_fm.fit(documents(spark, EDGE), labels.limit(0))).first().score == 0.5


PARTS = ["a", "The", " ", "  ", "\n", "\n\n", "\t", "'", "'s", "'ll", "!", "...", "23", "é", "漢字", "😀", "\u00a0", "\u2003", "\x1c", "<|endoftext|>", "<|", "²", "\r\n", "Ω", "\u200b", "x'", "Привет", "ф", "好世界", "ひら", "한국", "\u064e", "\u0301", "ǅ", "１", "'re", "'r", "e", "\x85", "\u180e", "𝒜"]


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(PARTS, rng.integers(1, 14))) for _ in range(4000)] + ["x" * 20000, "word " * 5000, "", None]
    rows = bpe.encoded(documents(spark, [(i, t, None, "x") for i, t in enumerate(texts)]), PATH).collect()
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_bpe_cuts_every_text_and_never_inside_a_token():
    own = bpe.Bpe(PATH)
    for text in ("The quick  brown fox's 123 jumps!\n\nOver.", "Съешь ещё этих мягких французских булок", "这是一个用来测试分词器的中文句子", "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία"):
        data = text.encode()
        every = own.cuts(data).tolist()
        assert len(every) > len(data) / 12
        for at in every:
            assert not own.inside[data[at - 1] << 8 | data[at]] and data[at] & 0xC0 != 0x80
    for c in "\x1c\x85\u180e'":  # unknown to some, or part of a contraction
        assert not len(own.cuts(f"a{c}a".encode()))


@pytest.mark.parametrize("segment", [1, 5, 64])
def test_bpe_fragments_do_not_change_the_ids(monkeypatch, segment):
    monkeypatch.setattr(bpe, "SEGMENT", segment)
    own, rng = bpe.Bpe(PATH), np.random.default_rng(segment)
    texts = ["".join(rng.choice(PARTS, rng.integers(0, 18))) for _ in range(3000)]
    ids, bounds = own.block(pa.array([None, *texts]).slice(1))
    for i, text in enumerate(texts):
        expected = own.library.encode(text, add_special_tokens=False).ids
        assert ids[bounds[i] : bounds[i + 1]].tolist() == expected and np.frombuffer(own.encode(text), "<u4").tolist() == expected


def test_bpe_forgets_and_encodes_alike(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own = bpe.Bpe(PATH)
    for text in ["one two three four five six"] * 3 + ["x" * 100_000, "Привет " * 9000]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == own.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 2_000_000, "a" + "\n" * 2_000_000 + "b", "é" + "\u00a0" * 2_000_000, "x" + " \n\t" * 700_000 + " y"])
def test_bpe_long_runs_of_blanks(text):
    own = bpe.Bpe(PATH)
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == own.library.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == text


def test_bpe_digests(spark):
    r = bpe.digests(documents(spark, [(1, "héllo wörld", None, "x")]), PATH).first()
    ids = np.array(Tokenizer.from_file(PATH).encode("héllo wörld", add_special_tokens=False).ids, "<u4").tobytes()
    assert r.ids_sha256 == hashlib.sha256(ids).hexdigest() and r.decoded_sha256 == hashlib.sha256("héllo wörld".encode()).hexdigest()
    assert bpe.digests(documents(spark, []), PATH).count() == 0


@pytest.mark.parametrize("window", [1024, 64])
def test_packing_covers_every_id_once(spark, window):
    rng = np.random.default_rng(3)
    texts = ["lorem ipsum " * int(n) for n in rng.geometric(0.01, 300)] + [None, "", "same text here"] + ["same text here"] * 150
    docs = documents(spark, [(i, t, None, "x") for i, t in enumerate(texts)])
    rows = packing.packed(docs, PATH, window=window).toPandas()
    library = Tokenizer.from_file(PATH)
    for i, own in rows.groupby("doc_id"):
        ids = np.array([*library.encode(texts[i] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in own.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert rows.doc_id.nunique() == len(texts)
    total = rows.groupby("sequence_id").length.sum()
    assert total.max() <= window and (total < window).sum() <= 1
    s = rows.sort_values(["sequence_id", "offset"])
    assert (s.groupby("sequence_id").length.cumsum() - s.length == s.offset).all()


def test_packing_plan_solves_least_squares():
    histogram = np.zeros(64, np.int64)
    histogram[[40, 24, 10]] = [100, 60, 170]  # 40 + 24, and 10 * 4 + 24
    x = packing.non_negative_least_squares(packing.combinations(64), histogram)
    assert (x >= 0).all()
    plan = packing.Plan.of(histogram, 64)
    assert plan.planned[40] >= 55 and plan.planned[24] >= 55


def test_packing_edge_cases(spark):
    assert packing.packed(documents(spark, []), PATH).count() == 0
    rows = packing.packed(documents(spark, EDGE), PATH).collect()
    whole = len(Tokenizer.from_file(PATH).encode("the the", add_special_tokens=False).ids) + 1
    assert sum(r.length for r in rows if r.doc_id == 6) == 2 * whole and {r.doc_tokens for r in rows if r.doc_id == 6} == {whole}
    assert sum(r.length for r in rows if r.doc_id == 1) == 1 and any(r.doc_id is None for r in rows)


def test_licences(spark):
    rows = [
        (11, "text\nNow released under the MIT License!\nmore", None, "x"),
        (12, "This work is licensed under the GNU General Public License, version 3.", None, "x"),
        (13, "about the license of birds", None, "x"),
        (14, licences.TEMPLATES["MIT-grant"].replace("free of charge", "free"), None, "x"),
    ]
    got = {r.doc_id: r for r in licences.scanned(documents(spark, rows + EDGE)).collect()}
    assert [got[i].licence for i in (11, 12, 13, 14)] == ["MIT", "GPL-3.0", None, "MIT-grant"]
    assert got[12].dice == 1.0 and got[11].dice == pytest.approx(8 / 9) and got[12].n_matches == 1 and 0.9 < got[14].dice < 1
    assert all(got[i].licence is None and got[i].n_matches == 0 for i in (1, 2, 3, 4, 5, 6, None))
    assert licences.scanned(documents(spark, [])).count() == 0


def test_own_columns_replace_clashing_ones(spark):
    docs = documents(spark, [(1, "Released under the MIT License.", None, "x"), (2, None, None, "x")])
    from pyspark.sql import functions as F

    for c in ("licence", "dice", "n_matches", "n_tokens", "ids", "decoded", "ids_sha256"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = licences.scanned(docs).orderBy("doc_id").collect()
    assert (got[0].licence, got[0].dice, got[0].n_matches, got[0].ids) == ("MIT", 1.0, 1, "clash") and got[1].licence is None
    got = bpe.encoded(docs, PATH).orderBy("doc_id").collect()
    assert got[0].decoded == got[0].text and got[0].licence == "clash" and got[1].n_tokens == 0
    assert bpe.digests(docs, PATH).count() == 2 and len(bpe.digests(docs, PATH).columns) == 4


def test_licences_of_equal_score(spark):
    same = {"B": "one two three four", "A": "one two three four", "C": "three four five six"}
    got = licences.scanned(documents(spark, [(1, "one two three four", None, "x"), (2, "three four five six\none two three four", None, "x")]), same, further={}).orderBy("doc_id").collect()
    assert [(r.licence, r.dice, r.n_matches) for r in got] == [("A", 1.0, 2), ("A", 1.0, 3)]


def wrapped(text, width=9):
    words = text.split()
    return "\n * ".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))


def test_licences_inside_other_text(spark):
    prose = " ".join(f"bird {k} of the coast was counted" for k in range(60)) + ". "
    notices = licences.TEMPLATES | licences.FURTHER
    rows = [(20, prose + "Released under the MIT License. " + prose, None, "x")]
    rows += [(30 + i, prose + "\n * " + wrapped(t) + " " + prose, None, "x") for i, t in enumerate(notices.values())]
    rows += [(21, prose + "\nReleased under the MIT License.\n" + prose + licences.TEMPLATES["GPL-3.0"] + " " + prose, None, "x"), (22, prose, None, "x")]
    rows += [(23, "Released under the MIT License. " * 2, None, "x"), (24, prose.join([licences.TEMPLATES["GPL-3.0"], licences.TEMPLATES["CC-BY-NC-4.0"]] * 40), None, "x")]
    got = {r.doc_id: r for r in licences.scanned(documents(spark, rows)).collect()}
    assert (got[20].licence, got[20].dice, got[20].n_matches) == ("MIT", 1.0, 1)
    for i, name in enumerate(notices):
        r = got[30 + i]
        assert r.licence == name and r.dice > 0.95 and r.n_matches >= 1, name
    assert got[21].licence == "GPL-3.0" and got[21].n_matches == 2  # the line and the run
    assert got[22].licence is None and got[22].n_matches == 0
    assert got[23].licence == "MIT" and got[24].n_matches == 80


def test_licence_runs_against_every_window():
    scanner = licences.Scanner(licences.TEMPLATES, 0.8, licences.FURTHER)
    rng, some = np.random.default_rng(6), [licences.TEMPLATES["MIT"], licences.TEMPLATES["GPL-3.0"], licences.TEMPLATES["CC-BY-NC-4.0"]]
    for _ in range(60):
        base = " ".join(rng.choice(["of", "the", "public", "under", "license", "licensed"], 20).tolist() + [str(rng.choice(some))] + ["the", "mit"] * 4)
        words = licences.normalised(base)
        for k in rng.integers(20, len(words), 2):
            words[k] = b"license"
        pairs = list(zip(words, words[1:], strict=False))
        for i, (_, own, _, _, _, span) in enumerate(scanner.runs):
            windows = [set(pairs[a:b]) for a in range(len(pairs)) for b in range(a + 1, min(a + span, len(pairs)) + 1)]
            top = max(2 * len(w & own) / (len(w) + len(own)) for w in windows)
            runs = scanner.best_runs(pairs, [k for k, g in enumerate(pairs) if g in own], i)
            assert max((x[3] for x in runs), default=0) == (top if top >= 0.8 - 1e-12 else 0)


def test_licence_pruning_loses_nothing():
    rng = np.random.default_rng(4)
    scanner = licences.Scanner(licences.TEMPLATES, 0.6)
    words = sorted({w for t in licences.TEMPLATES.values() for w in licences.normalised(t)})
    for _ in range(400):
        base = licences.normalised(list(licences.TEMPLATES.values())[rng.integers(len(licences.TEMPLATES))])
        for _ in range(rng.integers(0, 6)):
            base[rng.integers(len(base))] = words[rng.integers(len(words))]
        text = b" ".join(base).decode()
        own = licences.bigrams(base)
        brute = [(n, 2 * len(own & licences.bigrams(licences.normalised(t))) / (len(own) + len(licences.bigrams(licences.normalised(t))))) for n, t in sorted(licences.TEMPLATES.items())]
        assert scanner.matches(text) == [(n, s) for n, s in brute if s >= 0.6]


def test_language_id_equals_brute_force(spark):
    """Cross-entropies, predictions and scores of a fitted table against dictionaries; ties go to the language that sorts first."""
    rng = np.random.default_rng(12)
    parts = {"aa": ["ka", "lo", "Mi"], "bb": ["sch", "üng", "e-i"], "cc": ["ka", "üng", "Mi "]}
    some = lambda lang, n: " ".join("".join(rng.choice(parts[lang], 2)) for _ in range(n))
    rows = [(i, some(["aa", "bb", "cc"][i % 3], 12), ["aa", "bb", "cc"][i % 3], "x") for i in range(36)]
    docs = documents(spark, rows)
    models = language_id.fit(docs, per_language=10_000, held_back=1)  # a share of held-back rows below a thousandth is none
    alphabet = len({u for _, t, _, _ in rows for u in PlainKneserNey.units(t)}) + 1
    plain = {lang: PlainKneserNey([t for _, t, x, _ in rows if x == lang], alphabet) for lang in parts}
    probes = [some(x, 5) for x in parts for _ in range(3)] + ["Kaüng mi", "zzz", "lo", "KA lo, MI!", "é", "ka\n\nka"]
    got = language_id.identify(documents(spark, [(i, t, None, "x") for i, t in enumerate(probes)]), models).orderBy("doc_id").collect()
    for r in got:
        h = {lang: m.entropy(r.text) for lang, m in plain.items()}
        best = min(sorted(h), key=lambda x: round(h[x], 6))
        n = min(len(PlainKneserNey.units(r.text)), language_id.CERTAIN)
        assert r.lang_pred == best and r.cross_entropy == pytest.approx(h[best], rel=1e-5)
        assert r.score == pytest.approx(1 / sum(math.exp(-(x - h[best]) * n) for x in h.values()), rel=1e-3)


def test_language_ties_go_to_the_first(spark):
    rows = [(i, "same words here and there", None, "x") for i in range(4)]
    same = np.unique(language_id.Units()([rows[0][1]])[0], return_counts=True)
    models = language_id.LanguageModels.of_counts({"bb": same, "aa": same})
    got = language_id.identify(documents(spark, rows), models).collect()
    assert {r.lang_pred for r in got} == {"aa"} and len({r.score for r in got}) == 1 and got[0].score == pytest.approx(0.5)


def test_languages_learned_are_bounded(spark, languages):
    dirty = [(5000 + i, "one text of its own label", f"label{i}", "x") for i in range(30)]
    models = language_id.fit(documents(spark, languages + dirty), languages=3)
    assert models.languages == ["aa", "bb", "cc"]


def test_marks_alone_are_no_language(spark, languages):
    models = language_id.fit(documents(spark, languages))
    got = {r.doc_id: r for r in language_id.identify(documents(spark, [(1, "́̂ ́", None, "x"), (2, "́ ka", None, "x"), (3, "𐐀", None, "x"), (4, "😀 ٣", None, "x")]), models).collect()}
    assert [(got[i].lang_pred, got[i].score, got[i].rejected) for i in (1, 4)] == [("und", 0.0, True)] * 2
    assert got[2].lang_pred != "und" and got[3].lang_pred != "und"


def test_languages_of_tables_with_helper_names(spark, languages):
    docs = documents(spark, languages).withColumns({x: F.lit(1) for x in ("_lang", "_share", "key", "back", "count")})
    plain, other = language_id.fit(documents(spark, languages)), language_id.fit(docs)
    assert plain.languages == other.languages
    assert language_id.identify(docs, other).select("doc_id", "lang_pred", "score").collect() == language_id.identify(documents(spark, languages), plain).select("doc_id", "lang_pred", "score").collect()


def test_model_bytes_grow_with_languages_and_not_their_square(spark):
    rng = np.random.default_rng(4)
    size = {}
    for n in (10, 20, 40):
        counts = {}
        for i in range(n):  # every language in letters of its own
            units = (rng.integers(0, 20, (4, 3000)) + 500 + 40 * i).astype(np.uint64)
            keys = np.unique(units[0] << np.uint64(48) | units[1] << np.uint64(32) | units[2] << np.uint64(16) | units[3])
            counts[f"l{i:02}"] = keys, np.ones(len(keys), np.int64)
        size[n] = language_id.LanguageModels.of_counts(counts).nbytes
    assert size[20] < 2.1 * size[10] and size[40] < 2.1 * size[20]


def test_fitted_documents_are_bounded_over_all_languages(spark, languages):
    drawn = language_id.labelled_sample(documents(spark, languages), "lang", 1000, F.col("doc_id"), 500, 60)
    counts = {r.lang: r["count"] for r in drawn.groupBy("lang").count().collect()}
    assert set(counts) == {"aa", "bb", "cc"} and sum(counts.values()) < 120
