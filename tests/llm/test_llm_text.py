"""Quality rules, language identification, classifier, encoding, sequences against plain Python."""

import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factsieve.llm import arrow_sequences, bpe, knn_quality, lang_id, quality_rules
from llm_tables import SCHEMA, many, many_rows, none, odd, odd_rows, prose  # noqa: F401

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


# ---------------------------------------------------------------- quality rules

def plain_counts(text):
    words = (text or "").encode().split()
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += bool(line.encode().split()) and line in seen
        seen.add(line)
    return (len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered))


@pytest.mark.parametrize("seed", range(30))
def test_counts(seed):
    rng = random.Random(seed)
    text = "\n".join(" ".join(rng.choice(["a", "b", "ñ#", "<x>"]) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 12)))
    words = text.encode().split()
    assert quality_rules.base_counts(text, words) == plain_counts(text)


def test_rules(odd, many, none):
    rows = quality_rules.rate(odd).collect()
    assert len(rows) == len(odd_rows())
    texts = {r[0]: r[1] for r in odd_rows() if r[0] != 14}
    for r in rows:
        if r.doc_id in texts:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    assert quality_rules.rate(none).count() == 0


def test_divergence(spark):
    rng = random.Random(3)
    good = [(i, "The " + " ".join(rng.choice(["of", "and", "river", "stone", "light", "house"]) for _ in range(150)) + f" end{i}.", "en", "s", 1) for i in range(60)]
    junk = [(100, "# $ ".join(f"Q{rng.randint(0, 10**9)}" for _ in range(200)), "en", "s", 1), (101, " ".join(f"{rng.randint(0, 10**9)}" for _ in range(200)), None, "s", 1)]
    rows = {r.doc_id: r for r in quality_rules.rate(spark.createDataFrame(good + junk, SCHEMA)).collect()}
    assert all(rows[i].kept for i in range(60)) and not rows[100].kept and not rows[101].kept
    p, q = np.array([3.0, 1, 0]), np.array([1.0, 1, 2])
    m = (p / 4 + q / 4) / 2
    want = sum(a * np.log2(a / b) for v in (p / 4, q / 4) for a, b in zip(v, m) if a) / 2
    assert abs(quality_rules.js_distance(p, q) - np.sqrt(want)) < 1e-12 and quality_rules.js_distance(p, 0 * q) == 0


def test_without_common_words(spark):
    """Unknown words of ordinary letters lie below the word distance of 0.5, yet fail at any length judged."""
    rng = random.Random(5)
    def word(letters): return "".join(rng.choices(letters, k=rng.randint(3, 8)))  # noqa: E704
    common = {"en": ["the", "of", "and", "to", "in"], "fr": ["le", "des", "et", "une", "dans"]}
    def prose_of(lang, n): return " ".join(rng.choice(common[lang]) if rng.random() < 0.32 else word("abcdefghiklmnoprst") for _ in range(n))  # noqa: E704
    good = [(i, prose_of("en" if i % 2 else "fr", rng.choice([50, 80, 300])), "en" if i % 2 else "fr", "s", 1) for i in range(200)]
    bad = [(1000 + n, " ".join(word("abcdefghiklmnoprst") for _ in range(n)), lang, "s", 1) for n, lang in ((50, "en"), (400, "en"), (3000, "fr"), (3001, None))]
    bad.append((1001, prose_of("fr", 400), "en", "s", 1))
    rows = {r.doc_id: r for r in quality_rules.rate(spark.createDataFrame(good + bad, SCHEMA)).collect()}
    assert all(rows[i].kept for i, *_ in good)
    assert not any(rows[i].kept or rows[i].base_failed for i, *_ in bad)
    assert all(rows[i].word_distance < 0.5 for i, *_ in bad[:4])


# ---------------------------------------------------------------- language

def test_language(spark, odd, none):
    rng = random.Random(2)
    stems = {"en": ["the", "ing", "wh", "tion"], "de": ["sch", "keit", "der", "über"], "fr": ["eau", "oui", "ment", "très"]}
    rows = [(i, " ".join("".join(rng.choices(stems[g], k=2)) for _ in range(rng.randint(5, 80))), g, "s", 1)
            for i, g in enumerate(rng.choice([*stems]) for _ in range(300))]
    docs = spark.createDataFrame(rows, SCHEMA)
    learned = lang_id.learn(docs, F.col("doc_id") % 3 != 1)
    assert set(learned) == set(stems) and all(len(d) <= lang_id.DICTIONARY for d in learned.values())
    got = {r.doc_id: r for r in lang_id.identify(docs, learned).collect()}
    held = [r for r in rows if r[0] % 3 == 1]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) / len(held) > 0.95
    odd_got = {r.doc_id: r for r in lang_id.identify(odd, learned).collect()}
    assert all(odd_got[i].lang_pred == "und" and odd_got[i].score == 0 and odd_got[i].rejected for i in (4, 5, 6, 12))
    assert all(0 <= r.score <= 1 for r in odd_got.values()) and odd_got[13].lang_pred in stems
    assert lang_id.learn(none, F.lit(True)) == {} and lang_id.identify(none, {}).count() == 0
    assert {r.lang_pred for r in lang_id.identify(odd, {}).collect()} == {"und"}
    alone = lang_id.learn(docs.filter("lang = 'de'"), F.lit(True))
    assert lang_id.classify("schkeit überder", lang_id.compressors(alone))[0] == "de"


def test_language_of_long_documents_only(spark):
    """All training documents of a language are long; each prediction is the smallest sum of compressed blocks."""
    import zstandard

    rng = random.Random(8)
    stems = {"de": "sch keit ung über", "fr": "eaux tion çon être"}
    make = lambda lang, n: " ".join("".join(rng.choices(stems[lang].split(), k=rng.randint(1, 4))) for _ in range(n))
    rows = [(i, make("fr", 9_000), "fr") for i in range(6)] + [(10 + i, make("de", 300), "de") for i in range(20)] + [
        (100 + i, make("de" if i % 2 else "fr", rng.randint(1, 2_000)), None) for i in range(30)] + [(200, None, "fr"), (201, "", "de"), (202, "1 2", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = lang_id.learn(docs, F.col("doc_id") < 100)
    assert set(learned) == {"de", "fr"} and all(len(d) == lang_id.DICTIONARY for d in [learned["fr"]])
    options = zstandard.ZstdCompressionParameters.from_level(lang_id.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    coders = {lang: zstandard.ZstdCompressor(compression_params=options, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
              for lang, d in learned.items()}
    for r in lang_id.identify(docs, learned).collect():
        data = lang_id.letters(next(t for i, t, _ in rows if i == r.doc_id) or "")
        size = {lang: sum(len(c.compress(data[at:at + lang_id.BLOCK])) for at in range(0, len(data), lang_id.BLOCK)) for lang, c in coders.items()}
        if not data:
            assert r.lang_pred == "und"
        elif abs(size["de"] - size["fr"]) > 0.01 * max(size.values()):
            assert r.lang_pred == min(size, key=size.get), (r, size)
        if 100 <= r.doc_id < 200:
            assert r.lang_pred == ("de" if r.doc_id % 2 else "fr")


# ---------------------------------------------------------------- classifier

def test_classifier(spark, odd, none):
    rng = random.Random(4)
    rows = [(i, prose(rng, 60) if i % 4 else ("JUNK!! " * rng.randint(20, 60)), "en", "s", 1) for i in range(240)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(240)] + [(3, 1), (None, 1), (5, None)], "doc_id long, quality int")
    model = knn_quality.learn(docs, labels, F.col("doc_id") % 5 != 0)
    assert len(model.labels) == 192
    got = {r.doc_id: r for r in knn_quality.score(docs, model).collect()}
    assert all(got[i].predicted == int(i % 4 > 0) and 0 <= got[i].score <= 1 for i in range(0, 240, 5))
    # blocked products against one product for all
    near = model.embed(np.array([knn_quality.features(rows[i][1]) for i in range(50)])) @ model.vectors.T
    for i in range(50):
        top = np.argsort(-near[i], kind="stable")[:knn_quality.NEIGHBOURS]
        votes = np.maximum(near[i][top], 0).astype(float) ** knn_quality.SHARPNESS
        assert abs(got[i].score - (votes * model.labels[top]).sum() / votes.sum()) < 0.05
    odd_rows_ = knn_quality.score(odd, model).collect()
    assert len(odd_rows_) == len(odd_rows()) and {r.sha for r in odd_rows_} == {2}
    assert all(abs(r.score - model.prior) < 1e-9 for r in odd_rows_ if not r.text)
    untaught = knn_quality.learn(none, labels.limit(0), F.lit(True))
    assert {r.score for r in knn_quality.score(odd, untaught).collect()} == {0.5} and knn_quality.score(none, model).count() == 0


# ---------------------------------------------------------------- encoding

def test_bpe(odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    ours = bpe.vocabulary(path)
    rng = random.Random(6)
    letters = "aàÉß Σ's't\t\n 　.,!?日本1٣²İx" + "the and ing " * 3
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(800)] + [
        "<|startoftext|> Hello <|endoftext|>world", "x" * 5000, "ab" * 3000, "é <|endoftext|>", " "]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        ids = ours.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert ours.decode(ids) == library.decode(want, skip_special_tokens=False)
    rows = {r.doc_id: r.ids for r in bpe.encode_documents(odd, path).collect()}
    both = bpe.encode_and_decode(odd, path).collect()
    assert {r.doc_id: r.ids for r in both} == rows and all(r.decoded == ours.decode(r.ids) for r in both) and len(both) == len(odd_rows())
    assert bpe.encode_and_decode(none, path).count() == 0
    assert rows[4] == rows[5] == rows[6] == b"" and len(rows) == len({r[0] for r in odd_rows()})
    assert bytes(rows[10]) == np.array(library.encode(odd_rows()[9][1], add_special_tokens=False).ids, "<u4").tobytes()
    assert bpe.decode_documents(bpe.encode_documents(none, path), path).count() == 0


def test_bpe_all_characters():
    """Every code point that all versions of Unicode know, and some hundred thousandths of the others."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library, ours = tokenizers.Tokenizer.from_file(path), bpe.Vocabulary(path)
    known = unicodedata.ucd_3_2_0.category
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c % 97 == 0 or c < 0x600 or known(chr(c)) not in ("Cn", "Co", "Lo"))]
    points += [0x558, 0x58B, 0x58C, 0x88F, 0xC5C, 0x1C89, 0x208F, 0xA7CB, 0x1F600, 0x897]
    texts = [f"a{chr(c)}b {chr(c)} 1 e{chr(c)}\u0301\u0323" for c in points]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == want.ids, text.encode("unicode_escape")


@pytest.mark.parametrize("length", [8, 2048])
def test_sequences(spark, odd, many, none, tmp_path, length):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    for name, docs, rows in (("odd", odd, odd_rows()), ("many", many, many_rows())):
        scheme = "file://" if name == "odd" else ""  # without a scheme, Spark's default file system counts
        manifest = arrow_sequences.write_sequences(docs, f"{scheme}{tmp_path}/{name}{length}", path, 2, length)
        assert all(r.file.startswith("file:/") for r in manifest.collect())
        got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in arrow_sequences.read_documents(manifest).collect())
        start, want, stream = 0, [], []
        for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
            ids = library.encode(r[1] or "", add_special_tokens=False).ids + [2]
            want.append((start, r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start, stream = start + len(ids), stream + ids
        assert got == want
        back = []
        for r in manifest.orderBy("part").collect():
            content = arrow_sequences.Sequences(r.file)
            assert len(content) == r.n_sequences and content.length == length
            for i in range(len(content)):
                ids, mask = content[i]
                assert ids.base is not None and len(ids) == len(mask) == length
                back += [t for t, m in zip(ids.tolist(), mask.to_pylist()) if m]
        assert back == stream
    empty = arrow_sequences.write_sequences(none, f"file://{tmp_path}/none{length}", path)
    assert empty.count() == 0 and arrow_sequences.read_documents(empty).count() == 0
