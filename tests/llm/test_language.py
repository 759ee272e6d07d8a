import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import bigru
from cadenza.llm.language import LANGS, fit, judge, label_languages, named_language, score, train_networks
from cadenza.llm.prose import mask, sentences

WORDS = {
    "en": "the of and with this should have been there would which because after before through".split(),
    "de": "der und nicht wurde durch zwischen werden einen auch über schon wieder müssen".split(),
    "fr": "le des une pour avec cette qui sont être après depuis toujours où même".split(),
    "es": "el los una para con esta que son después desde siempre donde también más".split(),
    "it": "il gli una per con questa che sono dopo sempre dove anche più della".split(),
    "nl": "het een van voor met deze die zijn naar altijd waar ook meer worden".split(),
    "pt": "o os uma para com esta que são depois sempre onde também mais não".split(),
}


def text(lang, rng, n=9):
    return " ".join(rng.choice(WORDS[lang], n)).capitalize() + "."


@pytest.fixture(scope="module")
def weights():
    rng = np.random.default_rng(0)
    return fit([(c, text(c, rng)) for c in LANGS for _ in range(30)], [], hidden=16, steps=90, width=64, batch=24)


def test_gradients_match_differences():
    p = {k: v.astype(np.float64) * 2 for k, v in bigru.init(4, 3, 1).items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(60, 66, (6, 3)).astype(np.uint8), rng.integers(-1, 3, (6, 3))
    _, grad = bigru.gradients(p, x, y)
    for name, w in p.items():  # every weight of every table, both directions
        for i in np.ndindex(*w.shape):
            if name == "x" and not 60 <= i[2] < 66:
                assert grad[name][i] == 0
                continue
            old, side = w[i], []
            for step in (1e-5, -1e-5):
                w[i] = old + step
                pr = bigru.probabilities(p, x)
                side.append(-np.log(np.take_along_axis(pr, np.maximum(y, 0)[..., None], -1)[..., 0][y >= 0]).mean())
            w[i] = old
            assert abs((side[0] - side[1]) / 2e-5 - grad[name][i]) < 1e-8


def test_target_probabilities_equal_classes():
    p = bigru.init(4, 3, 1)
    rng = np.random.default_rng(4)
    x, y = rng.integers(60, 66, (6, 3)).astype(np.uint8), rng.integers(-1, 3, (6, 3))
    a, b = bigru.gradients(p, x, y), bigru.gradients(p, x, (y[..., None] == np.arange(3)).astype(np.float32))
    assert a[0] == b[0] and all((a[1][k] == b[1][k]).all() for k in p)


def test_held_out_accuracy(weights):
    rng = np.random.default_rng(99)
    texts = [(c, text(c, rng)) for c in LANGS for _ in range(20)]
    got = score([weights], [t for _, t in texts], [[(0, len(t))] for _, t in texts])
    right = np.mean([LANGS[int(g[0].argmax())] == c for (c, _), g in zip(texts, got)])
    assert right > 0.9


def test_mask_and_sentences():
    t = "Ein Satz mit `code here`. Noch einer!\n```py\nfor x in y:\n```\n    indented code\nSee https://x.test/a and [a link](b).\n<p>    code\n</p><p>Text</p>"
    m = mask(t)
    assert len(m) == len(t) and "code" not in m and "for x" not in m and "https" not in m and "link" not in m
    assert [t[a:b] for a, b in sentences(m)][:2] == ["Ein Satz mit `code here`.", "Noch einer!"] and "Text" in m
    assert mask("") == "" and sentences("") == [] and sentences(mask("```\nonly code\n```")) == []
    page = "<p>```json\n\"a\": 1\n```</p><p>Prose here.</p><p>```sh\nls\n```</p><p>    x = 1\n    y = 2</p><p>More.</p>"
    assert [page[a:b].strip() for a, b in sentences(mask(page))] and "Prose here." in mask(page) and "More." in mask(page)
    assert not any(w in mask(page) for w in ("a\"", "ls", "x =", "y ="))
    pre = "<pre><code>if x:\n    y = 1</code></pre></p><p>Words after the code.</p>"
    assert "Words after the code." in mask(pre)


def test_long_sentence_equals_whole(weights):
    rng = np.random.default_rng(5)
    long = " ".join(text("de", rng)[:-1] for _ in range(60))
    a = score([weights], [long], [[(0, len(long))]])[0][0]
    b = score([weights], [long], [[(0, len(long))]], width=4096)[0][0]
    assert np.abs(a - b).max() < 0.05


def test_sentences_read_once_and_members_pooled(weights):
    rng = np.random.default_rng(8)
    other = {k: v + rng.normal(0, 0.01, v.shape).astype(np.float32) for k, v in weights.items()}
    texts = [text(c, rng) for c in LANGS] * 2
    spans = [[(0, len(t))] for t in texts]
    known = {}
    both = score([weights, other], texts, spans, known=known)
    assert len(known) == len(LANGS) and all((a == b).all() for a, b in zip(both[:7], both[7:]))
    one, two = score([weights], texts[:7], spans[:7]), score([other], texts[:7], spans[:7])
    for a, b, c in zip(one, two, both):
        want = np.sqrt((a + 1e-4) * (b + 1e-4))
        assert np.abs(want / want.sum() - c).max() < 1e-3


def test_training_recovers_from_wrong_labels():
    """Wordings that only labelled documents have, a tenth of them under another label."""
    rng = np.random.default_rng(6)
    seen = {c: w[:7] for c, w in WORDS.items()}
    base = [(c, " ".join(rng.choice(seen[c], 8)) + ".") for c in LANGS for _ in range(12)]
    docs = [(c if rng.random() < 0.9 else LANGS[int(rng.integers(7))], text(c, rng)) for c in LANGS for _ in range(60)]
    w = fit(base, docs, hidden=16, steps=400, width=64, batch=24)
    new = [(c, " ".join(rng.choice(WORDS[c][7:], 8))) for c in LANGS for _ in range(20)]
    got = score([w], [t for _, t in new], [[(0, len(t))] for _, t in new])
    right = np.mean([LANGS[int(g[0].argmax())] == c for (c, _), g in zip(new, got)])
    assert right > 0.9, right


def test_judge():
    t = "This is a whole sentence. Kurz: Das ist ein ganzer Satz."
    sp = [(0, 25), (26, 31), (32, 56)]
    en, de, no = np.eye(7)[0] * 0.93 + 0.01, np.eye(7)[1] * 0.93 + 0.01, np.full(7, 1 / 7)
    langs, main, _, segs = judge(t, sp, np.array([en, no, de]), sure=0.75, words=4, letters=16)
    assert set(langs) == {"en", "de"} and main in langs and segs[0][2] == "en" and segs[-1][2] == "de"
    assert judge("", [], np.zeros((0, 7)), sure=0.7, words=4, letters=16)[0] == []


def test_names(spark):
    rows = [("EN", "en"), (" en-US ", "en"), ("deu", "de"), ("German", "de"), ("pt_BR", "pt"), ("xx", None), ("", None), (None, None), ("und", None), ("nld", "nl")]
    got = spark.createDataFrame(rows, "l string, want string").select(named_language(F.col("l")).alias("g"), "want").collect()
    assert all(r["g"] == r["want"] for r in got)


def test_documents(spark, weights):
    rng = np.random.default_rng(7)
    both = " ".join([text("en", rng) for _ in range(3)]) + "\n\n> " + " ".join(text("de", rng) for _ in range(3))
    rows = [(1, text("fr", rng) + " " + text("fr", rng), "x"), (2, both, "x"), (3, None, "x"), (4, "", "x"), (5, "```\nx = 1\n```", "x"), (6, " ".join(text("nl", rng) for _ in range(4000)), "x"), (1, text("fr", rng), "x")]
    got = label_languages(spark.createDataFrame(rows, "doc_id long, text string, main string"), [weights], words=3).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by[2][0]["langs"]) == {"en", "de"}
    assert [by[k][0]["main"] for k in (1, 3, 4, 5, 6)] == ["fr", None, None, None, "nl"]
    assert all(0 <= s["start"] < s["end"] for r in got for s in r["segments"])


def test_training_is_repeatable(spark):
    rng = np.random.default_rng(2)
    s = spark.createDataFrame([(i, c, text(c, rng)) for i, c in enumerate(LANGS * 3)], "sample_id int, lang string, text string")
    d = spark.createDataFrame([(i, text(c, rng), c) for i, c in enumerate(LANGS * 2)], "doc_id long, text string, lang string")
    a, b = (train_networks(d.repartition(k), s, members=2, hidden=4, steps=6, width=32, batch=4) for k in (1, 3))
    assert len(a) == len(b) == 2 and any((a[0][k] != a[1][k]).any() for k in a[0])
    assert all((x[k] == y[k]).all() for x, y in zip(a, b) for k in x)
