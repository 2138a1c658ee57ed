import collections

import pytest
from pyspark.sql import functions as F

from quillstate.llm import mixture, pii, pii_train, tokens

ODD = [
    (1, "Hello world's  end\n\n  x"), (1, "Hello world's  end\n\n  x"), (2, None), (3, ""), (None, "no id"), (4, "<|endoftext|> is text"), (5, "naïve ＡＢ １２３ 日本語の テキスト　x"),
    (6, "\r\n\t\x00\x1c\x1f\x85\xa0  ​﻿ é 👩‍👩‍👧 𐐷"), (7, "\U0001e900\U00031350 new letters\U000323b0 here"), (8, " " * 5000 + "x" * 5000 + "'ll'LL"), (9, "word " * 200_000), (10, "a  b   c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id bigint, text string").withColumn("block", F.lit("clash")).withColumn("ids", F.lit(1))


@pytest.mark.parametrize("block", [1000, 4_000_000])
def test_ids(spark, odd, monkeypatch, block):
    monkeypatch.setattr(tokens, "BLOCK_BYTES", block)
    enc = tokens.encoder(tokens.default_vocabulary())
    got = tokens.encode(odd).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(((i, enc.encode_ordinary(t or "")) for i, t in ODD), key=key)
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=key) == want
    counts = sorted(((r.doc_id, r.n_tokens) for r in tokens.token_counts(odd).collect()), key=key)
    assert counts == [(i, len(x)) for i, x in want]
    kept = tokens.token_counts(odd.withColumn("words", F.col("text")), keep=["block", "words"]).collect()
    assert len(kept) == len(ODD) and all(r.block == "clash" and r.n_tokens == len(enc.encode_ordinary(r.words or "")) for r in kept)


def test_decode_and_empty(spark, odd):
    single = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(single)).collect()}
    assert back == {i: t or "" for i, t in ODD if i is not None}
    some = spark.createDataFrame([(1, [31373], "k"), (1, [], "k"), (None, None, None)], "doc_id bigint, ids array<int>, decoded string")
    assert [tuple(r) for r in tokens.decode(some, keep=["decoded"]).collect()] == [(1, "k", "hello"), (1, "k", ""), (None, None, None)]
    with pytest.raises(Exception, match="out of bounds"):
        tokens.decode(spark.createDataFrame([(1, [60000])], "doc_id int, ids array<int>")).collect()
    assert tokens.encode(odd.limit(0)).count() == 0 and tokens.encode(odd.where("text is null")).collect()[0].ids == []


def sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


def test_texts_are_read_and_shuffled_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = tokens.encode(docs)._jdf.queryExecution().executedPlan()
    seen = tokens.encode(docs)
    seen.write.format("noop").mode("overwrite").save()
    text = plan.toString()
    assert text.count("FileScan") == 2 and text.count("text#") > 0  # AQE reuses the exchange when it runs
    ran = tokens.encode(docs)
    ran.collect()
    final = ran._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_equal_rows_are_told_apart_by_their_task(spark):
    same = spark.createDataFrame([(1, "a b")] * 400, "doc_id bigint, text string").repartition(8)
    assert tokens._blocks(same, [])[0].select("block").distinct().count() >= 1
    assert [len(r.ids) for r in tokens.encode(same).collect()] == [2] * 400


def test_mixing_keeps_weights_and_caps(spark, monkeypatch):
    monkeypatch.setattr(mixture, "CHUNK", 64)
    rows = [(i, "big", 10) for i in range(6000)] + [(10_000 + i, "small", 7) for i in range(100)] + [(20_000 + i, "poor", 5) for i in range(40)] + [(1, None, 5), (2, "other", 50), (30_000, "big", 0), (30_001, "small", None)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 30), ("poor", 0.25, 2), ("absent", 0.05, 9), ("big", 0.5, 1), (None, 0.1, 1)], "source string, weight double, max_repeats int")
    df = sizes(spark, rows)
    report, plan, corpus = mixture.mix(df, targets, 50)
    slots = plan.collect()
    by = collections.Counter(r.source for r in slots)
    n = len(slots)
    for s, w in (("big", 0.5), ("small", 0.2), ("poor", 0.25), ("absent", 0.05)):
        assert abs(by[s] - w * n) <= 12
        prefix = collections.Counter(r.source for r in slots if r.slot < n // 3)
        assert abs(prefix[s] - w * (n // 3)) <= 12  # any stretch is close to the weights
        of = [r.wanted for r in slots if r.source == s]
        assert max(of) - min(of) <= 1 and sum(of) == {"big": 30450, "small": 12180, "poor": 15225, "absent": 3045}[s]
    total, length = 60900, {(r[1], r[0]): r[2] for r in rows}
    made = corpus.collect()
    caps = {"big": 1, "small": 30, "poor": 2}
    used, uses, filled = collections.Counter(), collections.defaultdict(set), collections.Counter()
    for r in made:
        used[r.source, r.doc_id] += r.n_tokens
        uses[r.source, r.doc_id].add(r.use)
        filled[r.slot] += r.n_tokens
        assert 0 <= r.doc_from and r.doc_from + r.n_tokens <= length[r.source, r.doc_id] and r.n_tokens > 0
    assert all(len(u) <= caps[s] for (s, _), u in uses.items()) and all(t <= caps[s] * length[s, d] for (s, d), t in used.items())
    assert all(used["poor", d] == 10 for d in range(20_000, 20_040)) and len({d for s, d in used if s == "small"}) == 100
    assert dict(filled) == {r.slot: r.filled for r in slots if r.filled}  # slots are filled to the token
    shares = {r.source: r for r in mixture.shares(report, plan).collect()}
    assert shares["poor"].filled < shares["poor"].slots and shares["absent"].tokens == 0 and abs(sum(r.share for r in shares.values()) - 1) < 1e-9
    assert shares["big"].tokens == 30450 and shares["small"].tokens == 12180 and shares["poor"].tokens == 400
    assert {r.source for r in mixture.short_sources(plan).collect()} == {"poor", "absent"} and total == sum(r.wanted for r in slots)


def test_mixing_at_the_limit(spark):
    """A share equal to what a source has is met; one part in a thousand more is not."""
    df = sizes(spark, [(i, "a", 100) for i in range(10)] + [(100, "b", 1_000_000)])
    for weight, short in (("0.001998001", False), ("0.001998003", True)):
        targets = spark.createDataFrame([("a", float(weight), 2), ("b", 1 - float(weight), 1)], "source string, weight double, max_repeats int")
        assert ("a" in {r.source for r in mixture.short_sources(mixture.plan_mix(df, targets, 5000)[1]).collect()}) == short


def test_mixing_splits_long_documents_and_many_sources(spark):
    """Documents longer than blocks, sources lighter than a slot, rows that are equal, ids that are NULL."""
    rows = [(None, "s0", 1000)] * 3 + [(7, "s0", 10)] * 5 + [(i, f"s{i}", 3) for i in range(1, 300)]
    df = sizes(spark, rows).withColumn("text_hash", F.lit(5).cast("bigint"))
    targets = spark.createDataFrame([(f"s{i}", 0.7 if i == 0 else 0.3 / 299, 40) for i in range(300)], "source string, weight double, max_repeats int")
    report, plan, corpus = mixture.mix(df, targets, 64)
    got = {r.source: r for r in plan.groupBy("source").agg(F.sum("wanted").alias("w"), F.sum("filled").alias("f"), F.count("slot").alias("n")).collect()}
    assert len(got) == 300 and all(r.f == r.w for r in got.values()) and plan.select("slot").distinct().count() == plan.count()
    placed = {r.slot: r.t for r in corpus.groupBy("slot").agg(F.sum("n_tokens").alias("t")).collect()}
    assert placed == {r.slot: r.filled for r in plan.collect() if r.filled}


def test_mixing_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, weight double, max_repeats int")
    report, plan, corpus = mixture.mix(sizes(spark, []), targets)
    assert plan.count() == 0 and corpus.count() == 0
    assert mixture.shares(report, plan).first().share == 0.0
    none, plan, _ = mixture.mix(sizes(spark, [(1, "a", 5)]), targets.limit(0))
    assert none.count() == 0 and plan.count() == 0


TEXT = """Author: Ada van der Brookhart <ada_b@mill.test>

    Thanks to Dr. Rosa Lindqvist for the trace.
    Related to the Golden Harbor milestone; the cache stays behind a flag.
    Call 020 7946 0123 before rolling this back.
+ssn: 912-34-5678
+serial = "SN-86699386964"
+remote = git@code.example:cache/table.git
 The cache printed "17 Old Mill Lane" twice on the label.
 mail x.y at mill dot test for access
"""
WANT = [("name", "Ada van der Brookhart"), ("email", "ada_b@mill.test"), ("name", "Rosa Lindqvist"), ("phone", "020 7946 0123"), ("identity", "912-34-5678"), ("address", "17 Old Mill Lane"), ("email", "x.y at mill dot test")]


@pytest.fixture(scope="module")
def parts(spark):
    return spark.createDataFrame([("Ada", "given"), ("Rosa", "given"), ("Lindqvist", "family"), (None, "given"), ("Ada", "given")], "name_part string, role string")


def test_found_and_redacted(spark, parts):
    docs = spark.createDataFrame([(1, TEXT), (1, TEXT), (2, None), (3, ""), (4, "nothing here"), (None, "Cc: q@mill.test\r\n")], "doc_id bigint, text string").withColumn("kind", F.lit("clash"))
    got = [(r.kind, r.pii) for r in pii.find(docs.where("doc_id = 1").limit(1), parts).collect()]
    assert sorted(got) == sorted(WANT)
    assert [(r.kind, r.pii) for r in pii.find(docs.where("doc_id is null"), parts).collect()] == [("email", "q@mill.test")]
    clean = {r.doc_id: r.text for r in pii.redact(docs, parts).collect()}
    assert clean[2] is None and clean[3] == "" and clean[4] == "nothing here" and clean[None] == "Cc: <EMAIL>\r\n"
    text = TEXT
    for kind, s in WANT:
        text = text.replace(s, pii.PLACEHOLDER[kind])
    assert clean[1] == text
    assert pii.find(docs.limit(0), parts).count() == 0 and pii.find(docs, parts.limit(0)).count() > 0


def test_long_texts(spark, parts):
    long = "x" * 300_000 + " " + "Foo Bar " * 20_000 + "\n" + "1 " * 50_000 + "\n" + "\n".join(["Cc: a@mill.test"] * 500)
    docs = spark.createDataFrame([(1, long)], "doc_id bigint, text string")
    assert ("email", "a@mill.test") in {(r.kind, r.pii) for r in pii.find(docs, parts).collect()}


def test_accuracy_on_other_lines_of_the_forms():
    scores = pii_train.held_out(pii.Model.load(), 800, seed=4242, held=False)
    assert all(p > 0.97 and r > 0.97 for p, r in scores.values()), scores


def test_accuracy_on_forms_never_trained_on():
    (positive, negative), (kept, kept_negative) = pii_train.split_forms()
    assert not set(kept) & set(positive) and not set(kept_negative) & set(negative) and len(kept) > 60 and len(kept_negative) > 60
    scores = pii_train.held_out(pii.Model.load(), 1500, seed=4242)
    assert all(p > 0.85 and r > 0.85 for p, r in scores.values()), scores


def test_held_out_takes_the_path_of_find(monkeypatch):
    monkeypatch.setattr(pii_train, "spans_of", lambda text, decode: [])
    assert set(pii_train.held_out(pii.Model.load(), 50).values()) == {(0.0, 0.0)}


def test_training_learns():
    scores = pii_train.held_out(pii_train.train(n_lines=1500, epochs=3, verbose=False), 400, seed=11, held=False)
    assert all(p > 0.8 and r > 0.8 for p, r in scores.values()), scores


def every_span(model, line, gaz):
    """All candidates with the score of all their features: no bound, no cache."""
    return [(a, b, k, model.score(f)) for a, b, k, f in pii.candidates(line, gaz)]


def test_decoder_is_the_best_segmentation():
    """The dynamic program against all sets of non-overlapping spans, on short lines."""
    model, gaz = pii.Model.load(), pii.Gazetteer({"rosa"}, {"lindqvist"})
    for line in ("Rosa Lindqvist, 020 7946 0123", "ask Rosa, 5 Elm Road", "a@b.test 912-34-5678"):
        spans = every_span(model, line, gaz)
        best, stack = (0.0, []), [(0, "", 0.0, [])]
        while stack:
            at, last, v, path = stack.pop()
            best = max(best, (v, path), key=lambda x: x[0])
            for a, b, k, s in spans:
                if a >= at:
                    stack.append((b, k, v + s + model.w.get(f"trans:{last}>{k}", 0.0), [*path, (a, b, k)]))
        assert model.decode(line, gaz) == best[1]


def test_no_line_is_passed_over():
    """Whatever the candidates propose is decoded: family names like O'X, and all held-out lines."""
    model, gaz = pii.Model.load(), pii.Gazetteer({"amara", "zsofia"}, {"quistgaard"})
    decode = pii.decoder(model, gaz)
    for name, line in (("Amara O'Quistgaard", "Acked-by: {}"), ("Zsofia O'Adeyemkan", "    Gracias a {} por la traza."), ("Bjørn O'Strandvik", "Tested-by: {}")):
        text = "first line\n" + line.format(name) + "\nlast line"
        assert [(k, text[a:b]) for a, b, k in pii.spans_of(text, decode)] == [("name", name)]
    assert pii.spans_of("Signed-off-by: format-daemon", decode) == []  # a login, not a name in small letters
    for held in (False, True):
        maker = pii_train.Maker(77, held)
        for _ in range(1500):
            line, _, gaz = maker.line()
            assert pii.spans_of(line, pii.decoder(model, gaz)) == model.best(every_span(model, line, gaz)), line


def test_spans_that_no_best_segmentation_holds_are_left_out():
    """A line's own candidates say which neighbours a span can have: what is alone is kept only if it is found."""
    model, alone = pii.Model.load(), 0
    for held in (False, True):
        maker = pii_train.Maker(78, held)
        for _ in range(1000):
            line, _, gaz = maker.line()
            every = every_span(model, line, gaz)
            kept, best = model.spans(line, gaz), model.best(every)
            assert set(best) <= {c[:3] for c in kept}, line
            if every and max(c[0] for c in every) < min(c[1] for c in every):
                alone += 1
                assert bool(kept) == bool(best), line
    assert alone > 100


def test_runs_that_repeat_are_valued_once(monkeypatch):
    """The insides of like runs of digits and of words are worked out once, whatever stands around them."""
    seen, shape, words = [], pii._digit_key, pii._NAME_WORD
    model, gaz = pii.Model.load(), pii.Gazetteer({"amara"}, {"quistgaard"})
    monkeypatch.setattr(pii, "_digit_key", lambda s, cut: seen.append(s) or shape(s, cut))
    monkeypatch.setattr(pii, "_NAME_WORD", type("", (), {"finditer": lambda self, s: seen.append(s) or words.finditer(s)})())
    decode = pii.decoder(model, gaz)
    for i in range(2, 8):
        text = f"[{'x' * i}] Quistgaard, Amara: +44 1632 96012{i} {'y' * i}"
        assert [(k, text[a:b]) for a, b, k in pii.spans_of(text, decode)] == [("name", "Quistgaard, Amara"), ("phone", f"+44 1632 96012{i}")]
    assert len(seen) == 2, seen


def test_the_operator_is_the_model_on_every_line(spark):
    """All documents of the test tables: bounds, caches and like digits change no result."""
    d = "/root/testdata/sf0.01"
    model, gaz = pii.Model.load(), pii.Gazetteer.of(pii.name_rows(spark.read.parquet(f"{d}/name_parts.parquet")))
    decode, lines = pii.decoder(model, gaz), set()
    for r in spark.read.parquet(f"{d}/documents.parquet").select("text").where("text is not null").toLocalIterator():
        lines |= {x.rstrip("\r") for x in r.text.split("\n")}
    for line in lines:
        assert pii.spans_of(line, decode) == model.best(every_span(model, line, gaz)), line


def test_lines_that_tools_write_are_read(spark, parts):
    """Queries, headers and hunks hold cases like any other line."""
    lines = {
        "SELECT id FROM users WHERE email = 'jane.roe@mill.test' AND tel = '+44 1632 960123'": [("email", "jane.roe@mill.test"), ("phone", "+44 1632 960123")],
        "CREATE USER for ops@mill.test": [("email", "ops@mill.test")],
        "+++ b/AUTHORS Rose Wentor <rose@x.test>": [("name", "Rose Wentor"), ("email", "rose@x.test")],
        "commit by Rose Wentor <rose@mill.test>": [("name", "Rose Wentor"), ("email", "rose@mill.test")],
        "@@ -1,2 +1,2 @@ mail jane@x.test": [("email", "jane@x.test")],
        "Call 555-0123 before rolling this back.": [("phone", "555-0123")],
        "My SSN is 123-45-6789": [("identity", "123-45-6789")],
        "Mein Name ist Peter Müller": [("name", "Peter Müller")],
        "Please send it to Kevin Larsson by Friday": [("name", "Kevin Larsson")],
        "Call John Smith at +44 1632 960123": [("name", "John Smith"), ("phone", "+44 1632 960123")],
        "index 0988449..1234567 100644": [],
        "Date:   Sun Mar 08 11:43:47 2015 +0100": [],
    }
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    found = {}
    for r in pii.find(docs, parts).collect():
        found.setdefault(r.doc_id, []).append((r.kind, r.pii))
    for i, (line, want) in enumerate(lines.items()):
        assert sorted(found.get(i, [])) == sorted(want), line


def test_every_street_word_passes_the_filter():
    """Lines with a span of an address are never taken for lines without one."""
    for w in [*pii.STREET_END, *pii.STREET_START, *("Alt" + x for x in pii.STREET_SUFFIX)]:
        words = pii._words(w)
        assert not pii._STREETS.isdisjoint(words) or not pii._TAILS.isdisjoint([x[-3:] for x in words]), w
