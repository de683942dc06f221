import itertools
import random

from quarryline.llm import overlap as O


def records(spark, rows):
    return spark.createDataFrame([(i, s, "r", t, None) for i, (s, t) in enumerate(rows)], "record_id long, split string, repository_id string, query_text string, ingested_at timestamp")


FILL = [(("train", "validation")[i % 2], f"Explain how `load_{a}_{b}_table` sorts the {c} before the first {d} arrives.") for i, (a, b, c, d) in enumerate(itertools.product(("route", "panel", "ledger"), ("gateway", "packet"), ("cursor", "window"), ("token", "batch")))]


def test_variants_are_found_and_others_are_not(spark):
    base = "Where does `merge_panel_packet_table` check the gateway when two cursor entries share one window?"
    rows = [
        ("train", base), ("test", base),
        ("test", "Hi, when two cursor entries share one window, where does mergePanelPacketTable check the gateway? Thanks!"),
        ("validation", "Where does MERGE_PANEL_PACKET_TABLE currently chekc the gateway when two curso entries share one…"),
        ("test", "where does the merge step of the panel packet table check the g\u0430teway when two cursor entries share one window?"),
        ("test", base.replace("panel", "route")), ("test", "Replace the three boolean arguments of `merge_panel_packet_table` by one ledger object."),
        (None, base), ("train", None), ("test", " "), ("test", "?"),
    ]
    df = records(spark, rows + FILL * 3)
    got = {(r.record_id_a, r.record_id_b) for r in O.pairs(df.unionByName(df)).collect() if r.record_id_a < len(rows) and r.record_id_b < len(rows)}
    assert got == {(0, 1), (0, 2), (0, 3), (0, 4)}


def near_copies(spark, n=240):
    rng = random.Random(4)
    words = "route panel ledger gateway packet cursor window token batch thread".split()
    rows = []
    for _ in range(n):
        a, b, c, d = rng.sample(words, 4)
        text = f"Explain how `load_{a}_{b}_table` sorts the {c} before the first {d} arrives."
        rows.append((rng.choice(("train", "test")), rng.choice((text, text.replace("Explain", "Describe in detail"), "We looked into it yesterday without luck. " + text, text + " Some help is welcome."))))
    return rows, records(spark, rows)


def asks_the_same(x, y):
    (n, b), (m, c) = x, y
    shared, fewer = len(set(b) & set(c)), min(len(b), len(c))
    named = set(n) <= set(m + c) and set(m) <= set(n + b) and len(set(n) & set(m)) >= min(2, len(n), len(m))
    return named and shared >= O.LEAST * fewer and shared >= min(fewer, 2)


def distance(x, y):
    return sum((int(a) ^ int(b)).bit_count() if a >= 0 <= b else ((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(O.simhash(*x), O.simhash(*y)))


def test_recall_against_brute_force_and_codes_differ(spark):
    rows, df = near_copies(spark)
    got = {(r.record_id_a, r.record_id_b) for r in O.pairs(df).collect()}
    known = O.frequent_words(O.questions(df).select("tokenised").distinct())
    reduced = [O.reduced(" ".join("_".join(p) for p in O.tokens(t)), known) for _, t in rows]
    same_names = {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if rows[i][0] != rows[j][0] and reduced[i][0] == reduced[j][0] and asks_the_same(reduced[i], reduced[j])}
    assert len(same_names & got) >= 0.97 * len(same_names) > 0
    assert all(asks_the_same(reduced[i], reduced[j]) for i, j in got)
    apart = [distance(reduced[i], reduced[j]) for i, j in got]
    assert max(apart) <= O.RADIUS and sum(d > 0 for d in apart) > len(apart) / 4


def test_hot_blocks_lose_no_pair(spark, monkeypatch):
    _, df = near_copies(spark)
    plain = {tuple(r) for r in O.pairs(df).collect()}
    monkeypatch.setattr(O, "HOT", 0)
    assert {tuple(r) for r in O.pairs(df).collect()} == plain


def test_empty_and_report(spark):
    df = records(spark, [("train", "Find `a_b_c` now."), ("test", "Find `a_b_c` now.")])
    assert O.pairs(df.limit(0)).count() == 0
    assert [(r.split, r.records, r.overlapping) for r in O.report(df.withColumn("class_id", O.F.lit("x"))).collect()] == [("test", 1, 1)]


def test_no_pair_within_the_radius_is_missed(spark, monkeypatch):
    rng = random.Random(3)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    rows = []
    for i in range(120):
        code = rng.getrandbits(128)
        # every block differs, in as many bits as the radius allows; and one bit more
        spread = [rng.sample(range(O.BITS), n) for n in rng.sample([1, 1, 2, 2, 2, 2, 2, 2 + i % 2], 8)]
        other = code
        for at, bits in enumerate(spread):
            for bit in bits:
                other ^= 1 << (at * O.BITS + bit)
        for side, c in (("a", code), ("b", other)):
            rows.append((f"{side}{i}", ["n"], ["w"] if i % 3 else [], signed(c >> 64), signed(c & (2**64 - 1)), side == "a", side == "b"))
    reps = spark.createDataFrame(rows, "class_id string, name array<string>, body array<string>, high long, low long, has_train boolean, has_evaluation boolean")
    wanted = sorted((f"a{i}", f"b{i}") for i in range(0, 120, 2))
    assert sorted(map(tuple, O.candidates(reps).collect())) == wanted
    monkeypatch.setattr(O, "HOT", 0)
    assert sorted(map(tuple, O.candidates(reps).collect())) == wanted
