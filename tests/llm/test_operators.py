"""The operators without contracts: quotes, lines, mixing, attribution, the pipeline."""

import bisect
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from glassine.llm import attribution, linededup, mixing, queries, quotes
from glassine.llm.shared import connected_components


WORDS = "walk talk read write sing swim cook bake plant paint carve build climb dance".split()

# --- quotes -----------------------------------------------------------------------------------------------------------

CHAT = [
    (1, 0, "user", "How do I sort a table by two keys at once?"),
    (1, 1, "assistant", "Use orderBy with both of the columns."),
    (1, 2, "user", "And what about the nulls then, please?"),
    (1, 3, "assistant", "On Monday someone wrote:\n> How do I sort a\n> table by two keys at once?\nBy the way, sort works too."),
    (1, 4, "user", "> > How do I sort a table by two keys at once?\n> By the way, sort works too.\nThanks for telling me about it"),
    (1, 5, "user", "> And what about the NULLS then, please?\nThey go first"),
    (2, 0, "user", "> How do I sort a table by two keys at once?\nNot in this conversation"),
    (2, 0, "user", "> How do I sort a table by two keys at once?\nNot in this conversation"),
    (None, None, None, None),
    (3, 0, "user", ""),
]


def test_quotes(spark):
    df = spark.createDataFrame([(*r, 7, "x") for r in CHAT], "conv_id long, turn long, role string, text string, position int, conv string")
    got = quotes.conversations(df).orderBy("conv_id", "position").collect()
    assert len(got) == len(CHAT)
    one = [(r["turn"], r["reply_to"], r["depth"], r["thread"]) for r in got if r["conv_id"] == 1]
    assert one == [(0, None, 0, 0), (3, 0, 1, 0), (4, 3, 2, 0), (1, None, 0, 1), (2, None, 0, 2), (5, 2, 1, 2)]
    four = next(r for r in got if r["conv_id"] == 1 and r["turn"] == 4)
    assert [tuple(q) for q in four["quotes"]] == [(1, 3), (2, 0)] and four["text"] == "Thanks for telling me about it"
    assert [(r["position"], r["reply_to"]) for r in got if r["conv_id"] == 2] == [(0, None), (1, None)]
    assert quotes.conversations(df.limit(0)).count() == 0


def test_long_chain_of_replies(spark):
    text = lambda i: f"Message number {i} says something"
    rows = [(1, i, "user", (f"> {text(i - 1)}\n" if i else "") + text(i)) for i in range(40)]
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all((r["depth"], r["thread"], r["position"]) == (r["turn"], 0, r["turn"]) for r in got)


def test_generated_conversations(spark):
    """Every link, chain and order of generated conversations, known from how they were made."""
    rng = random.Random(6)
    say = lambda conv, turn: f"In {conv} at {turn} we {' '.join(rng.choice(WORDS) for _ in range(6))}."
    rows, want = [], {}
    for conv in range(25):
        own, quoted, parent = [], [], []
        for turn in range(rng.randrange(1, 15)):
            text = "\n".join(say(conv, turn) for _ in range(rng.randrange(1, 4)))
            to = rng.randrange(turn) if turn and rng.random() < 0.7 else None
            lines = []
            if to is not None:
                mark = rng.choice([">", "> "])
                lines = [f"{mark}{x}" for x in quoted[to] + own[to].upper().split("\n")]
                if rng.random() < 0.5:
                    lines = ["On Monday a person wrote:", *lines]
            rows.append((conv, turn, "user", "\n".join([*lines, text])))
            own.append(text)
            quoted.append([x for x in lines if x.startswith(">")])
            parent.append(to)
        thread, depth = [], []
        for turn, to in enumerate(parent):
            thread.append(turn if to is None else thread[to])
            depth.append(0 if to is None else depth[to] + 1)
        order = sorted(range(len(parent)), key=lambda t: (thread[t], t))
        for turn, to in enumerate(parent):
            levels, at = [], to
            while at is not None:
                levels.append(at)
                at = parent[at]
            want[conv, turn] = (order.index(turn), own[turn], to, depth[turn], thread[turn], [(i + 1, t) for i, t in enumerate(levels)])
    rng.shuffle(rows)
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(want)
    for r in got:
        have = (r["position"], r["text"], r["reply_to"], r["depth"], r["thread"], [tuple(q) for q in r["quotes"]])
        assert have == want[r["conv_id"], r["turn"]]


def test_ids_that_are_no_numbers(spark):
    rows = [("a", "1", "user", "Some words that are said here"), ("a", "2", "user", "> Some words that are said here\nYes"), ("b", "x", "user", None)]
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id string, turn string, role string, text string")).collect()
    assert sorted((r["turn"] or 0, r["reply_to"] or 0, r["position"]) for r in got) == [(0, 0, 0), (1, 0, 0), (2, 1, 1)]


def test_queries_without_quotes(spark, sf):
    got = quotes.query(spark, sf)
    want = spark.read.parquet(f"{sf}/conversations.parquet")
    order = {r[0]: [] for r in want.select("conv_id").distinct().collect()}
    for r in got.orderBy("conv_id", "position").collect():
        order[r["conv_id"]].append(r["turn"])
    assert all(turns == sorted(turns) for turns in order.values()) and sum(map(len, order.values())) == want.count()


def test_short_messages_are_quoted_whole(spark):
    rows = [(1, 0, "user", "Sounds good!"), (1, 1, "user", "Something else"), (1, 2, "user", "> Sounds good!\nGreat"), (1, 3, "user", "> !!!\nWhat")]
    rows += [(2, 0, "user", "好的。"), (2, 1, "user", "> 好的。\n谢谢"), (2, 2, "user", "ok\n\nA longer paragraph of words"), (2, 3, "user", "> ok\nYes")]
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r["conv_id"], r["turn"]): r["reply_to"] for r in got if r["reply_to"] is not None} == {(1, 2): 0, (2, 1): 0}


# --- lines ------------------------------------------------------------------------------------------------------------


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    n = len(a) if len(a) < len(b) else len(b)
    p = next((i for i in range(n) if a[i] != b[i]), n)
    if len(a) == len(b):
        return a[p + 1 :] == b[p + 1 :]
    a, b = (a, b) if len(a) < len(b) else (b, a)
    return a[p:] == b[p + 1 :]


def brute_lines(rows, least=20):
    lines, seen, out = [], [], defaultdict(list)
    ordered = sorted(enumerate(rows), key=lambda r: (r[1][0] is None, r[1][0] or 0, r[0]))
    for at, (doc_id, text) in ordered:
        for n, line in enumerate((text or "").split("\n")):
            lines.append((at, n, line.strip(" ")))
    for at, n, line in lines:
        drop = None
        if line:
            if len(line) >= least and any(len(s) >= least and s != line and within_one(s, line) for s in seen):
                drop = "near"
            elif line in seen:
                drop = "copy"
        seen.append(line)
        out[at].append(drop)
    # Near lines are near wherever the first of them stands.
    return out


def test_lines(spark):
    base = "the quick brown fox jumps over the lazy dog again"
    rows = [
        (3, f"{base}\nshort\n\n{base}"), (1, base.replace("quick", "quack") + "\nshort"), (2, base[:-1] + "\n" + base + "x\n" + base.replace("fox", "fo x")),
        (4, None), (5, ""), (6, base.replace("lazy", "lzay")), (7, "ab" * 3000), (8, "ab" * 2999 + "a"), (None, base), (9, "shorx"), (9, "shorx"),
        (10, "élan vital and other french words"), (11, "elan vital and other french words"), (12, "aaaaaaaaaaaaaaaaaaaaaaaa"), (13, "aaaaaaaaaaaaaaaaaaaaaaaaa"),
    ]
    df = spark.createDataFrame([(*r, 1, "z", 2) for r in rows], "doc_id long, text string, line int, h string, id int").coalesce(1)
    got = defaultdict(dict)
    ranks = {}
    for r in linededup.line_decisions(df).orderBy("row", "line").collect():
        ranks.setdefault(r["row"], len(ranks))
        got[ranks[r["row"]]][r["line"]] = r["drop"]
    want = brute_lines(rows)
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == dict(want)
    clean = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df.where("doc_id IN (1, 2, 3)")).collect()}
    assert clean[1] == base.replace("quick", "quack") + "\nshort" and clean[3] == ""
    assert linededup.line_decisions(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf, name):
    from pathlib import Path

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df, want = queries.queries()[name](spark, sf), con.sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    take = lambda columns, data: sorted(repr([r[columns.index(c)] for c in order]) for r in data)
    assert take(df.columns, df.collect()) == take(want.columns, want.fetchall())


# --- mixing -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 5, "b": 1, "c": 1, "d": 0.01}, {f"s{i}": 1 + i % 7 for i in range(150)}, {"h": 0.5} | {f"t{i}": 0.05 for i in range(10)}])
def test_schedule_deviates_by_less_than_a_block(weights):
    period = 1000
    slots = mixing.shares(weights, period)
    assert sum(slots.values()) == period
    laid = mixing.schedule(slots, period)
    assert sorted(t for _, _, t in laid) == list(range(period))
    given = Counter()
    by_slot = {t: (s, k) for s, k, t in laid}
    for t in range(period):
        s, k = by_slot[t]
        assert k == given[s] and k * period // slots[s] <= t < -(-(k + 1) * period // slots[s])
        given[s] += 1
        assert all(abs(given[x] - n * (t + 1) / period) < 1 for x, n in slots.items())


def test_capped_weights():
    w = mixing.capped({"a": 90, "b": 5, "c": 5, "d": 5, "e": 5})
    assert w["a"] == 0.25 and math.isclose(sum(w.values()), 1) and w["b"] == w["c"]
    assert mixing.capped({"a": 3}) == {"a": 1.0} and mixing.capped({}) == {}


def test_mix_against_brute_force(spark, docs, odd):
    block, period = 3000, 100
    rows = [r for r in mixing.mix(docs, F.length("text"), block=block, period=period).collect()]
    assert len(rows) == docs.count()
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["doc"]["source"]].append((r["block"], len(r["doc"]["text"]) + 1, r))
    sizes = {s: sum(n for _, n, _ in v) for s, v in by_source.items()}
    # Blocks are cuts of the source's running size.
    for s, v in by_source.items():
        starts, total = defaultdict(int), 0
        for k, group in itertools.groupby(sorted(v, key=lambda x: x[0]), key=lambda x: x[0]):
            assert total // block <= k
            total += sum(n for _, n, _ in group)
            starts[k] = total
            assert total > k * block
    slots = mixing.shares(mixing.capped(sizes), period)
    laid = {(s, k): t for s, k, t in mixing.schedule(slots, period)}
    for s, v in by_source.items():
        for k, _, r in v:
            assert r["slot"] == k // slots[s] * period + laid[s, k % slots[s]]
            assert r["release"] <= r["slot"] < r["deadline"]
    horizon = min(-(-(-(-sizes[s] // block)) * period // n) for s, n in slots.items())
    assert all(r["selected"] == (r["release"] < horizon) for r in rows)
    some = mixing.mix(odd, F.length("text"), {"a": 1.0}).collect()
    assert len(some) == odd.count() and {r["slot"] is None for r in some if r["doc"]["source"] != "a"} == {True}
    assert mixing.mix(odd.limit(0), F.length("text")).count() == 0


def test_a_tiny_source_does_not_end_the_mixture(spark):
    rows = [(i, f"s{i % 5}", 1000) for i in range(5000)] + [(5000, "tiny", 50), (5001, None, 50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    got = mixing.mix(df, F.col("n"), block=20).collect()
    assert len(got) == len(rows) and all(r["selected"] for r in got)
    # A source that binds by its target weight still ends the mixture, whatever the others' sizes.
    some = mixing.mix(df, F.col("n"), {"s0": 0.5, "s1": 0.25, "tiny": 1e-7}, block=1001).where("selected").groupBy("doc.source").count()
    assert {r[0]: r[1] for r in some.collect()} == {"s0": 1000, "s1": 500, "tiny": 1}


# --- attribution ------------------------------------------------------------------------------------------------------


def test_attribution_of_other_scripts(spark, sf, texts):
    """Tokens that hold parts of characters, against the library's own offsets; and the query's totals."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(attribution.VOCABULARY))
    rows = [(1, "naïve café\n漢字かな交じり文\n🙂🙂 fin\nñandú"), (2, "漢\n字\n🙂\n"), (3, "\n\né\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for rule in ("first", "last"):
        got = {(r["doc_id"], r["section"]): r["n_tokens"] for r in attribution.attribute(docs, rule=rule).collect()}
        for doc_id, text in rows:
            starts = [0, *(i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text))]
            want = Counter()
            for a, b in library.encode(text, add_special_tokens=False).offsets:
                want[bisect.bisect_right(starts, a if rule == "first" else b - 1) - 1] += 1
            assert [got[doc_id, s] for s in range(len(starts))] == [want[s] for s in range(len(starts))]
    totals = attribution.query(spark, sf).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in totals} == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution(spark, odd, rule):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(attribution.VOCABULARY))
    sections = lambda text: sorted({0, *(m.end() for m in re.finditer(r"[.\n] |a|\n", text) if m.end() < len(text))})
    got = attribution.attribute(odd, sections, rule).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (str(r["doc_id"]), r["section"])):
        by[r["doc_id"]].append(r)
    for row in odd.collect():
        text, doc = row["text"] or "", by[row["doc_id"]]
        n = 2 if row["doc_id"] == 5 else 1
        ids = library.encode(text, add_special_tokens=False).ids
        assert sum(r["n_tokens"] for r in doc) == n * len(ids)
        if n == 2 or not text:
            continue
        starts = sections(text)
        assert [r["char_start"] for r in doc] == starts
        if text.isascii():
            want, at = Counter(), 0
            for i in ids:
                token = library.decode([i])
                a, b = at, at + len(token)
                at = b
                overlap = Counter(bisect.bisect_right(starts, c) - 1 for c in range(a, b))
                first, last = min(overlap), max(overlap)
                most = min(overlap, key=lambda s: (-overlap[s], s))
                want[{"first": first, "last": last, "most": most}[rule]] += 1
            assert [r["n_tokens"] for r in doc] == [want[i] for i in range(len(starts))]
    assert attribution.attribute(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        attribution.attribute(odd, rule="half")


# --- components and the pipeline --------------------------------------------------------------------------------------


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (7, 7), (400, 401), (401, 400)]
    hub = [(1000, 1000 + i) for i in range(1, 200)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert {got[i] for i in range(51)} == {0} and got[300] == 100 and got[401] == 400 and got[1100] == 1000
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, sf, docs):
    import corpus_pipeline as p

    kept = docs
    sizes = []
    for i, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, kept, sf)
        if i < len(p.STAGES) - 1:
            assert out.columns == docs.columns, name
        kept = spark.createDataFrame(out.toPandas(), out.schema)
        sizes.append(kept.count())
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < docs.count()
    run = p.run(spark, sf)
    assert run.count() == sizes[-1]


def test_stages_take_odd_documents(spark, sf, odd):
    import corpus_pipeline as p

    stages = dict(p.STAGES)
    assert {r["doc_id"] for r in stages["language_id"](spark, odd, sf).collect()}.isdisjoint({1, 2, 3, 6})
    near = stages["near_dedup"](spark, odd, sf)
    assert near.columns == odd.columns
    assert sorted((r["doc_id"] for r in near.collect()), key=str) == [1, 3, 4, 5, 7, 8, None]
    assert stages["decontamination"](spark, odd, sf).count() == odd.count()
    assert stages["mix"](spark, odd, sf).columns == odd.columns
    for name, stage in p.STAGES:
        assert stage(spark, odd.limit(0), sf).count() == 0, name


