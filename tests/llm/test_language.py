import re
import zlib

import regex
from cases import SF, frame

from vetra.llm import language


def test_held_out_accuracy_and_shape(spark):
    sf = SF.replace("0.001", "0.01")
    rows = language.op2_language(spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_and_ids_are_no_inputs():
    model = language.Classifier({"en": b"the and of with that have from " * 30, "fr": "été après être pour les avec dans ".encode() * 30})
    assert model.predict("with that and from the")[0] == "en"
    assert model.predict("AVEC LES POUR ÊTRE ÉTÉ DANS LES APRÈS AVEC POUR")[0] == "fr"
    assert model.predict(None)[0] == model.predict("12 34 _ !")[0] == model.predict("")[0] == model.predict("½ ² ③ Ⅷ")[0] == "und"


def test_awkward_and_empty(spark):
    docs = frame(spark)
    got = language.identify(docs, language.fit(docs)).collect()
    assert len(got) == docs.count()
    assert {r.lang_pred for r in got} <= {"en", "fr", "und"}
    none = frame(spark, [])
    assert language.fit(none) == {}
    assert language.identify(none, {}).count() == 0
    assert {r.lang_pred for r in language.identify(docs, {}).collect()} == {"und"}


def test_predictions_against_scalar_code(spark):
    """Compressed sizes of blocks, one by one, with dictionaries of whatever fit gives."""
    import zstandard as z

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    dictionaries = language.fit(docs)
    text = {r.doc_id: r.text for r in docs.collect()}
    params = z.ZstdCompressionParameters.from_level(3, hash_log=16, chain_log=16, min_match=4, strategy=z.STRATEGY_GREEDY, search_log=4, window_log=18, write_content_size=False, write_checksum=False, write_dict_id=False)
    for r in language.identify(docs, dictionaries).collect():
        t = text[r.doc_id]
        if not regex.search(r"\p{L}", t or ""):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
            continue
        t = re.sub(r"[\W\d_]+", " ", t.lower())
        sizes = {}
        for lang, raw in dictionaries.items():
            sizes[lang] = sum(len(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params).compress(t[i : i + 2000].encode())) for i in range(0, len(t), 2000))
        best, second = sorted(sizes.values())[:2]
        assert sizes[r.lang_pred] == best and r.margin == (second - best) / second and r.accepted == (r.margin >= language.MARGIN)


def test_the_sample_is_bounded_and_the_lowest_by_hash(spark):
    docs = spark.createDataFrame([(i, f"the words of text {i} and more of it", "en") for i in range(3000)], "doc_id long, text string, lang string")
    few, all_ = language.fit(docs, sample_docs=20), language.fit(docs, sample_docs=10**6)
    assert list(few) == ["en"] and 20 * 20 < len(few["en"]) < 20 * 60 < len(all_["en"])


def test_columns_with_the_names_of_results(spark):
    docs = frame(spark).selectExpr("*", "1 AS score", "'x' AS lang_pred", "true AS accepted", "0 AS margin")
    got = language.label(docs, language.fit(docs))
    assert got.columns[-4:] == ["lang_pred", "score", "margin", "accepted"] and got.select("lang_pred").distinct().count() > 1


def test_every_language_of_many_has_a_dictionary(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_TOTAL", 400 * 1500)
    rows = [(i, f"word{i % 300} other{i % 300} third", f"l{i % 300}", None, 1) for i in range(1800)]
    got = language.fit(frame(spark, rows), 5, 1500)
    assert len(got) == 300
