import math
import random
import zlib

import numpy as np
import pytest
import zstandard

from inkfold.llm.toxicity import CUTS, FAINT_CUTS, FEATURES, MOST_LOST, STEP, WINDOW, Model, Savings, Training, best_cut, calibrate, drop_toxic, features, fit_toxicity, score_texts, score_toxicity, train_dictionaries, windows_of

SYLLABLES = ["an", "ber", "cor", "del", "en", "fi", "gar", "hu", "in", "jo", "ka", "lum", "mo", "ner", "os", "pli", "qua", "ri", "sto", "ven"]
BAD = ["worthless", "pathetic", "disgusting", "stupid"]


def corpus(n, seed=1):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(40, 160))]
        toxic = r.random() < 0.4
        if toxic:
            for _ in range(len(words) // 12 + 2):
                words.insert(r.randrange(len(words)), r.choice(BAD))
        docs.append((i, " ".join(words), "en"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_windows_cover_the_text():
    for n in (0, 1, WINDOW, WINDOW + 1, STEP, 1000):
        text = "".join(chr(97 + i % 26) for i in range(n))
        ws = windows_of(text)
        covered = set()
        for k, w in enumerate(ws):
            covered |= set(range(k * STEP, k * STEP + len(w)))
        assert covered == set(range(n)) and all(len(w) <= WINDOW for w in ws)
    none = np.zeros(0, dtype=np.int64)
    assert len(features(none, none)) == len(Model().weights) == FEATURES


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus(900)
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").repartition(4)
    told = labels + [(3, None), (None, 1), (5, labels[5][1])]
    model = fit_toxicity(d, spark.createDataFrame(told, "doc_id bigint, toxic int"))
    truth = dict(labels)
    got = score_toxicity(d, model).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got) and len(held) > 200
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    long = " ".join(t for i, t, _ in docs if truth[i])
    edge = spark.createDataFrame([(1, None), (2, ""), (3, long), (None, "x"), (2, "")], "doc_id bigint, text string")
    edge = edge.selectExpr("*", "'q' AS score", "1 AS windows")
    rows = score_toxicity(edge, model).collect()
    assert len(rows) == 5 and [r.predicted for r in rows if r.doc_id in (1, 2)] == [0, 0, 0]
    assert [r.predicted for r in rows if r.doc_id == 3] == [1] and [r.held_out for r in rows if r.doc_id is None] == [False]
    kept = drop_toxic(edge, model)
    assert kept.schema == edge.schema and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "2", "None"]
    assert score_toxicity(edge.limit(0), model).count() == 0 and drop_toxic(edge.limit(0), model).count() == 0


def test_labels_of_held_out_documents_are_not_read(spark):
    docs, labels = corpus(240, 2)
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")

    def fitted(pairs):
        return fit_toxicity(d, spark.createDataFrame(pairs, "doc_id bigint, toxic int"))

    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    assert fitted(labels) == fitted(other)


def test_no_labels_at_all(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    for labels in ([], [(1, 0)], [(1, 1)]):
        model = fit_toxicity(d, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
        assert score_toxicity(d, model).first().predicted == 0


def plain_score(model, text):
    """The score by a plain loop over the windows, from its description."""
    raw = (text or "").lower().encode()

    def size(content, window, whole):
        how = zstandard.ZstdCompressionParameters.from_level(
            model.level, source_size=64, dict_size=whole, min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        held = {"dict_data": zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if content else {}
        return len(zstandard.ZstdCompressor(compression_params=how, **held).compress(window))

    saved, faint, at = [], [], 0
    while raw and (at == 0 or at + 16 < len(raw)):
        window = raw[at : at + 64]
        both = model.toxic + model.ordinary
        saved.append(size(model.ordinary, window, len(both)) - size(both, window, len(both)))
        pair = [size(c, window, len(c)) for c in (model.faint_ordinary, model.faint_toxic)] if model.faint_toxic else [0, 0]
        faint.append(pair[0] - pair[1])
        at += 48
    x = [0.0] * FEATURES
    if saved:
        n = len(saved)
        x = [sum(v >= c for v in saved) / n for c in CUTS] + [min(max(saved), 12), math.log1p(sum(v >= 4 for v in saved))]
        x += [sum(v >= c for v in faint) / n for c in FAINT_CUTS] + [sum(max(-8, min(8, v)) for v in faint) / n]
    z = model.bias + sum(w * (v - m) / s for w, v, m, s in zip(model.weights, x, model.mean, model.scale, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_scores_equal_a_plain_loop(spark):
    docs, labels = corpus(300, 3)
    # Toxic documents without any of the toxic words: more of some ordinary ones.
    docs += [(1000 + i, " ".join(["quaner corlum"] * 3 + [docs[i][1][:200]] + ["quaner"] * 2), "en") for i in range(60)]
    labels += [(1000 + i, 1) for i in range(60)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    model = fit_toxicity(d, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    texts = [*(t for _, t, _ in docs[::7]), None, "", "x", "a" * 5000, " ".join(t for _, t, _ in docs[:40])]
    got = score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model)
    scores = {r.doc_id: r.score for r in got.collect()}
    assert model.faint_toxic and all(scores[i] == pytest.approx(plain_score(model, t), abs=1e-9) for i, t in enumerate(texts))


def test_cut_off():
    z = np.array([5.0, 4, 3, 3, 2, 1, 0, -1, -2, -3, -4, -5, -6, -7, -8, -9])
    y = np.array([1.0, 1, 1, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0])
    one = np.ones(len(z))
    # Equal values stay together: the third 3 takes a clean document along, more than may be lost of twelve is not.
    assert best_cut(z, y, one) == 3.5 and 1 / 12 > MOST_LOST
    many = np.where(y == 1, 1.0, 10.0)
    many[3] = 1
    assert best_cut(z, y, many) == 1.5
    assert best_cut(z, 1 - y, one) > z[0]


def many_forms(n, seed):
    """Texts whose toxic words are stems with any of many endings: some 400 forms, each in few documents."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))
    docs = []
    for i in range(n):
        words = [word() for _ in range(r.randint(100, 300))]
        for _ in range(i % 2 * r.randint(1, 4)):
            words.insert(r.randrange(len(words)), r.choice(["vyxaw", "sczyx", "twyvoj", "gxywob"]) + r.choice(SYLLABLES) + r.choice(["", *SYLLABLES]))
        docs.append((" ".join(words), i % 2))
    return docs


def test_many_forms_of_toxic_words():
    """The toxic dictionary has room for them: nearly all such documents are found, and few clean ones lost."""
    fit, test, held = (many_forms(n, seed) for n, seed in ((800, 1), (400, 2), (400, 3)))
    toxic, ordinary = ([windows_of(t) for t, y in fit if y == kind] for kind in (1, 0))
    y = np.array([y for _, y in test], dtype=float)
    fitted = []
    for model in train_dictionaries(toxic, ordinary, Training()):
        saved = Savings(model)
        fitted.append(calibrate(model, np.array([saved.features(windows_of(t)) for t, _ in test]), y, np.ones(len(y))))
    model = min(fitted, key=lambda x: x[1])[0]
    called = score_texts(model, [t for t, _ in held]) >= 0.7
    truth = np.array([y for _, y in held]) == 1
    assert called[truth].mean() >= 0.9 and called[~truth].mean() <= 0.1
