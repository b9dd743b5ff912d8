import os
import random

import numpy as np
import pytest

from darkroom.llm.bpe import Encoder, count_tokens, encode_documents, tokenizer_path
from darkroom.llm.packing import evolve, pack_documents, packed, packing_summary
from darkroom.llm.residue import Exemplars, passages, residue_documents

DOCS = "doc_id long, text string, ids string, n int"
PATH = tokenizer_path("byte_bpe_50k")
needs_vocabulary = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file")


def texts():
    rng = random.Random(4)
    odd = ["", " ", "\n\n\t ", "a" * 3000, "." * 500, " " * 700, "<|endoftext|>", "don't we'll I'VE", "ﬁ№½Ⅳ", "👩‍👩‍👧‍👦", "ページが見つかりません", "\u0000​﻿", "تمت مراجعة", "x y", "0123456789" * 50, "naïve Ünïcödé"]
    alphabet = "abcdefgh ABC.,;:!?0123 \n\t'-éüß中文字かな👍"
    return odd + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200))) for _ in range(300)]


@needs_vocabulary
def test_encoding_against_the_library(spark):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    rows = [(i, x, "z", 1) for i, x in enumerate(texts())]
    out = {r["doc_id"]: r["ids"] for r in encode_documents(spark.createDataFrame(rows + rows[:5] + [(9999, None, "z", 1), (None, "x", "z", 1)], DOCS), PATH).collect()}
    assert len(out) == len(rows) + 1 and out[9999] == []
    for i, x, *_ in rows:
        assert out[i] == t.encode(x, add_special_tokens=False).ids, x[:40]
    n = {r["doc_id"]: r["tokens"] for r in count_tokens(spark.createDataFrame(rows, DOCS), PATH).collect()}
    assert n == {i: len(out[i]) for i in n}
    assert encode_documents(spark.createDataFrame([], DOCS), PATH).count() == 0


@needs_vocabulary
def test_encodings_spell_their_text():
    e = Encoder(PATH)
    import json

    model = json.load(open(PATH, encoding="utf-8"))["model"]["vocab"]
    from darkroom.llm.bpe import _byte_letters

    letters, spell = _byte_letters(), {i: s for s, i in model.items()}
    for x in texts():
        ids = [i for w in e.learn([x])[0] for i in e.known[w]]
        assert bytes(letters[c] for i in ids for c in spell[i]).decode("utf-8") == x


SIZES = "doc_id long, tokens long, part string, bin int"


def test_containers_hold_everything_once(spark, staging):
    rng = random.Random(5)
    sizes = {i: rng.choice([0, 1, 7, 2048, 2049, 4096, 9999, rng.randrange(1, 2048), rng.randrange(1, 300)]) for i in range(600)}
    rows = [(i, n, "x", 1) for i, n in sizes.items()] + [(700, None, "x", 1), (None, 5, "x", 1)]
    out = pack_documents(spark.createDataFrame(rows, SIZES), "doc_id", "tokens", 2048, staging).toPandas()
    held = out.groupby("doc_id")["size"].sum().to_dict()
    assert held == {**sizes, 700: 0}
    full = out[out["container"].notna()].groupby("container")["size"].sum()
    assert full.max() <= 2048 and not out.duplicated(["doc_id", "part"]).any()
    for i, own in out.groupby("doc_id"):
        assert len(own) == max(1, -(-sizes.get(i, 0) // 2048))
    # Never worse than best fit decreasing over all parts at once.
    parts = np.array([min(2048, n - at) for n in sizes.values() for at in range(0, n, 2048)])
    assert len(full) <= -packed(parts, 2048, np.argsort(-parts, kind="stable")).score(2048)[0]


def test_crossover_improves_a_hard_case():
    rng = np.random.default_rng(6)
    sizes = rng.integers(500, 1100, 900)
    first, best = packed(sizes, 2048, np.argsort(-sizes)), evolve(sizes, 2048, rng, 40, [])
    assert np.bincount(best.where, weights=sizes).max() <= 2048 and (best.where >= 0).all()
    assert best.score(2048) > first.score(2048)


def test_islands_beat_best_fit_where_it_falls_short(spark, staging, monkeypatch):
    from darkroom.llm import packing

    monkeypatch.setattr(packing, "ROUNDS", 1)
    rng = np.random.default_rng(21)
    # Containers filled by three documents each: best-fit decreasing doesn't find the triples again.
    a, b = rng.integers(400, 900, 60), rng.integers(400, 900, 60)
    sizes = np.concatenate([a, b, 2048 - a - b])
    df = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "doc_id long, tokens long")
    alone = int((packed(sizes, 2048, np.argsort(-sizes, kind="stable")).fill > 0).sum())
    r = packing_summary(df, "doc_id", "tokens", 2048, staging).collect()[0]
    assert r["best_fit"] == alone and r["least"] == 60 and r["documents"] == r["parts"] == 180
    assert 60 <= r["containers"] < alone


def test_nothing_to_pack(spark, staging):
    assert pack_documents(spark.createDataFrame([], SIZES), "doc_id", "tokens", 2048, staging).count() == 0


RESIDUE = [
    "Dear {{ name }}, the album from Rovdal is ready for review.", "Caption: NaN", "Photos: [object Object]\nThe lease ran out.", "Hello %s,", "This picture shows &lt;place&gt; at Tjorva.", "Lorem ipsum dolor sit amet. Consectetur aliqua.",
    "Sample paragraph. Sample paragraph.", "The requested album does not exist.", "<p>HTTP Error 503. The review service is temporarily unavailable.</p>", "PLEASE ENABLE JAVASCRIPT TO VIEW THIS ALBUM.", "This  viewer  relies  on  JS;  switch it on.", "A long walk by the lake. " * 4000 + "\nYour browser does not support scripting, so this content cannot be shown.",
    "ここに説明文が入ります。", "{\"error\": {\"code\": 404, \"message\": \"no such page\"}}", "The collection ${folder} now holds Yulva Oquendal photos.",
]
CONTENT = [
    None, "", "  \n ", "]]>--//##", "…………", "<|endoftext|>", "The requested box of slides came on Monday, and the album is complete.", 'Last week the caption showed the literal text "{{ name }}" to two reviewers; it is fixed.', "Syntax reference: a marker such as {{folder}} stands for a field and is filled in when the page is built.",
    'The unit test checks that "Access denied" is shown to guests and that the real album is shown to owners.', "Error rates fell from 0.4 to 0.2.", "Review note 1392", "Browsers that ask users to enable JavaScript were tested too.", "Width < height in most of them [sic], 5 > 3.", "404 photos turned out to be screenshots.",
    'In the settings file the line path = "${ARCHIVE_ROOT}/derived" is correct as it stands, since the launcher expands it at start.', "Somebody left \"lorem ipsum\" in the mock-up of the help page, which we replaced with a real explanation in the same commit.", "TODO: rescan strip 4, rename the folder and ask for the names on the back.",
]


def test_residue(spark):
    rows = [(i, x, "z", 1) for i, x in enumerate(RESIDUE + CONTENT)]
    rows += rows[:2] + [(None, RESIDUE[0], "z", 1)]
    got = sorted(r["doc_id"] for r in residue_documents(spark.createDataFrame(rows, DOCS)).collect())
    assert got == list(range(len(RESIDUE)))


def test_no_documents_no_residue(spark):
    assert residue_documents(spark.createDataFrame([], DOCS)).count() == 0


MENU = "home albums people places map timeline settings help about contact imprint privacy terms search login register favourites share export print"
FLATTENED = [
    "404 page not found Rovdal archive viewer home", "please enable javascript to view this album", "internal server error", "description to be written", "the requested album does not exist", "sample paragraph sample paragraph",
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor", "your browser does not support javascript so this content cannot be shown", "ここに説明文が入ります",
]


def test_exemplars_in_windows_of_long_passages():
    own = Exemplars({}, 1000)
    for text in FLATTENED:
        assert any(own.is_residue(*p) for p in passages(text))
        assert any(own.is_residue(*p) for p in passages(f"{MENU} {text} {MENU}")), text
    for text in [MENU, "She wrote that the next part of the album is coming soon and we believed it", "Nobody had told us that photography was forbidden in the chapel on that day", "The letter to the aunt who kept the box has to be written by Monday",
                 "The old link returned 404 not found after the folder rename, so the catalogue now keeps a redirect and nobody has complained since then"]:
        assert not any(own.is_residue(*p) for p in passages(text)), text


def test_markers_and_filler_must_outweigh_what_describes_them():
    own = Exemplars({}, 1000)
    for text in ["In our letters the placeholder {{ owner }} is replaced by the name of the album's owner.", "A field such as ${title} stands for the album's title.", "The variable %HOME% is expanded to the folder of the account.", "The words lorem ipsum dolor are filler."]:
        assert not any(own.is_residue(*p) for p in passages(text)), text
    for text in ["Dear {{ owner }}, your placeholder album is ready.", "Kept in ${title} by the owner.", "%HOME% is where we met.", "The words. Lorem ipsum dolor sit amet elit.", "{{ a }}"]:
        assert any(own.is_residue(*p) for p in passages(text)), text


# Written without looking at the exemplars or the tables.
HELD_RESIDUE = ["Dear {{customer.name}}, your order has shipped.", "Hello ${firstName}, welcome back to the club!", "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.", "404 Not Found", "HTTP Error 503. The service is unavailable.", "Please enable JavaScript to continue using this application.",
 "You need to enable JavaScript to run this app.", "Access denied. You do not have permission to access this page.", "Coming soon", "Insert your text here.", "Internal Server Error", "Error establishing a database connection", "This page requires JavaScript. Turn it on in your browser settings and reload.",
 "Your session has expired. Please sign in again to continue.", "Welcome <%= user.name %> to your account", "Photo taken by [[PHOTOGRAPHER]] in [[CITY]]", "Something went wrong while loading this page. Please try again later.", "The page you requested could not be located on this server.", "Too many requests. Slow down and retry in 30 seconds.", "JavaScript is disabled in your browser. Please activate it and reload."]
HELD_OTHERS = ["We walked along the coast until the rain came.", "The documentation says that {{name}} is replaced with the recipient's name.", "He returned to the page and found the error himself.", "The museum is closed on Mondays.", "The word lorem appears on the slide because the designer left it.", "In JavaScript, a closure keeps its variables alive.", "The ticket says the server answered 503 during the restart and then recovered.",
 "A placeholder such as ${city} is replaced with the city at export.", "The unit test checks that access denied is shown to guests.", "Our session in the studio expired the budget.", "She asked whether more was coming soon and left.", "The album has 404 pictures, none of them found again.", "const name = `${first} ${last}`;", "The new build works without any JavaScript.", "Retry the scan of the third strip tomorrow.", "The caption names three people and a dog.", "Fixed an internal server error when a file had no name.", "The forbidden city was crowded in May.", "I sat by the gate and read the service manual.", "The template language uses {% if %} for conditions."]


def test_held_out_texts():
    own = Exemplars({}, 1000)
    residue = lambda t: any(own.is_residue(*p) for p in passages(t))
    assert sum(map(residue, HELD_RESIDUE)) >= 18 and sum(map(residue, HELD_OTHERS)) <= 2
