import random

import numpy as np

from quarryline.llm import subjects as S

TERMS = {"law": "court verdict statute bailiff notary tribunal clause".split(), "music": "violin chord tempo melody sonata octave choir".split(), "sport": "referee goalkeeper striker podium sprint coach marathon".split()}
SAID = ["The importer maps every {} to a {}.", "Reports list the {} and the {}.", "Users asked for a {} view next to the {} list.", "Fixes the {} total that ignored a late {}."]
OTHER = ["The cache is rebuilt whenever the {} changes.", "Set `{}` to false to skip the {}.", "The build fails if a {} shadows the {}.", "Run the test suite before the {} is tagged."]
CODE = "mount cursor ledger socket panel hatch router signal".split()


def corpus(seed, n):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        own = rng.sample(sorted(TERMS), rng.choice([0, 1, 1, 1, 2]))
        lines = [rng.choice(SAID).format(*rng.sample(TERMS[s], 2)) for s in own for _ in range(rng.randint(2, 4))]
        lines += [rng.choice(OTHER).format(*rng.sample(CODE, 2)) for _ in range(rng.randint(2, 6))]
        if rng.random() < 0.3:
            spare = rng.choice(sorted(set(TERMS) - set(own)))
            lines.append(rng.choice(SAID).format(TERMS[spare][0], TERMS[spare][1]))
        rng.shuffle(lines)
        docs.append((i, " ".join(lines)))
        truth[i] = set(own) or {"software"}
    return docs, truth


def test_held_out_accuracy(spark):
    docs, truth = corpus(5, 500)
    docs += [(900, ""), (901, None), (902, "  \n "), (903, "<p>Der Rest.</p>")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = [(10 * i + k, i, f" {s.title()}", f"lab{k}") for i in range(0, 160) for k, s in enumerate(sorted(truth[i]))]
    rng = random.Random(6)
    labels = [(a, b, rng.choice(["Law", "music"]) if rng.random() < 0.05 else c, d) for a, b, c, d in labels]
    lab = spark.createDataFrame(labels, "label_id long, doc_id long, subject string, labelled_by string").selectExpr("*", "timestamp('2024-01-01') as labelled_at")
    table = spark.createDataFrame([(s, "") for s in [*TERMS, "software"]], "subject string, description string")
    got: dict[int, set] = {}
    for r in S.assigned(df, lab.unionByName(lab), table).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held = [i for i in truth if i >= 160]
    right = sum(len(got[i] & truth[i]) for i in held)
    said, want = sum(len(got[i]) for i in held), sum(len(truth[i]) for i in held)
    assert right / said > 0.93 and right / want > 0.93
    assert 900 not in got and 901 not in got and 902 not in got and got[903] == {"software"}
    assert {r.subject for r in S.assigned(df, lab.limit(0), table).collect()} == {"software"}
    assert S.assigned(df.limit(0), lab, table).count() == 0


def test_words():
    assert list(S.sentences("Call `mergeSeminar()` now. Größe der Flüsse!\n<b>FlÃ¼sse</b>")) == [["call", "merge", "seminar", "now"], ["grosse", "der", "flusse"], ["flusse"]]
    assert list(S.sentences(None)) == [] and list(S.sentences(" \n ")) == []


def test_numbers_of_all_words_in_one_pass():
    texts = ["One fooBar two.  Three…\n\n four_five?! <b>six</b> : ", None, "", "...\r\n\t", "x.y  z\n \nQ! ", "fooBar\nBAZqux one", "tail. ", "étés 12 fooBar. bar"]
    vocabulary = S.Vocabulary({w: 9 for w in ("one", "foo", "bar", "two", "four", "x", "z", "qux", "ete", "12")})
    owner, starts, numbers = S._numbered(texts, vocabulary)
    wanted = [(i, [vocabulary.numbers.get(vocabulary.speller.mend(w), S.RARE) for w in words]) for i, t in enumerate(texts) for words in S.sentences(t)]
    assert [(i, n.tolist()) for i, n in zip(owner.tolist(), np.split(numbers, starts[1:]))] == wanted
    assert all(len(x) == 0 for x in S._numbered([None, "", "\n"], vocabulary))
