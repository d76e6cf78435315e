"""Each stage of the pipeline, and the whole, against brute force on a table with nulls, empties, ties, repeats and clashing names."""

import collections
import hashlib
import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from test_operators import DOCS_COLUMNS, brute_near, make

SPEECH = {"xx": "alpha beta gamma delta lambda sigma omega theta".split(), "yy": "omkra tuzzo brinq welko zuqar dorli fesna hupit".split()}


def documents():
    """(id, text, lang, source) rows; those of unlike or no language come last."""
    rng = random.Random(21)
    rows = []
    for i in range(160):
        lang = rng.choice(["xx", "yy"])
        rows.append([i, " ".join(rng.choice(SPEECH[lang]) for _ in range(rng.randint(12, 120))), lang if i % 5 else None, rng.choice(["b", "b", "b", "a", None])])
    for i, (_, text, lang, source) in enumerate(rows[:40]):
        words = text.split()
        rows.append([200 + i, rng.choice([text, text.upper(), text, text + " " + words[0]]), lang, rng.choice([source, "c"])])
    rows += [[7, rows[7][1], "xx", "a"], [7, rows[8][1] + " beta", "xx", "a"], [None, rows[9][1], None, None], [None, "alpha omega " * 30, None, "a"], [300, "alpha", "xx", "a"], [301, "alpha beta", "xx", "a"]]
    garbage = [[400 + i, t, None, "a"] for i, t in enumerate([None, "", "12 345 !", *(" ".join("".join(rng.choice("cjvkxw") for _ in range(7)) for _ in range(n)) for n in (40, 400))])]
    return rows, garbage


def frame(spark, rows):
    return make(spark, [r[1] for r in rows], ids=[r[0] for r in rows], langs=[r[2] for r in rows], sources=[r[3] for r in rows])


def content(df):
    assert df.columns == DOCS_COLUMNS
    return collections.Counter((r.doc_id, r.text, r.source) for r in df.collect())


def counter(rows):
    return collections.Counter((r[0], r[1], r[3]) for r in rows)


def keep_one(rows, key):
    """Of rows with one key that with the smallest id, nulls last; rows whose key is None all stay."""
    groups = collections.defaultdict(list)
    for r in rows:
        groups[key(r)].append(r)
    return groups, lambda r: (r[0] is None, r[0])


def brute_exact(rows):
    groups, order = keep_one(rows, lambda r: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or ""))
    return groups, order


def brute_mix(rows):
    """Copies of each row: sources share the words by weights 5, 2, 1, none beyond three times its own."""
    size = lambda r: len((r[1] or "").split())
    own = collections.Counter()
    for r in rows:
        own[r[3]] += size(r)
    sources = sorted(own, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, open_, left = {}, list(sources), sum(own.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if 3 * own[s] <= level * weight[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        s = min(over, key=lambda s: 3 * own[s] / weight[s])
        target[s], left = 3.0 * own[s], left - 3 * own[s]
        open_.remove(s)
    out = []
    for s in sources:
        budget = int(np.floor(target[s] + 0.5))
        epochs, rest = divmod(budget, own[s]) if own[s] else (0, 0)
        before = 0
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: (hashlib.md5(f"{'' if r[0] is None else r[0]}|mix".encode()).hexdigest(), size(r))):
            out += [r] * (epochs + (2 * (rest - before) > size(r)))
            before += size(r)
    return out


def brute_pieces(rows, tokenizer):
    out = collections.Counter()
    for i, text, *_ in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        out.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])))
    return out


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_exact(got, rows):
    groups, order = brute_exact(rows)
    assert sum(got.values()) == len(groups)
    for members in groups.values():
        left = [r for r in members if got[(r[0], r[1], r[3])]]
        assert left and min(map(order, left)) == min(map(order, members))


def check_near(got, rows):
    classes, _ = brute_near([(r[0], r[1]) for r in rows])
    of = collections.defaultdict(list)
    for r, (c, _) in zip(rows, classes):
        of[c].append(r)
    assert sum(got.values()) == len(of) - (None in of) + len(of.get(None, []))
    for c, members in of.items():
        left = [r for r in members if got[(r[0], r[1], r[3])]]
        assert (len(left) == len(members)) if c is None else min((r[0] is None, r[0]) for r in left) == min((r[0] is None, r[0]) for r in members)


def check_packed(out, rows, tokenizer):
    found = out.collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == brute_pieces(rows, tokenizer)
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def rows_of(df):
    return [[r.doc_id, r.text, r.lang, r.source] for r in df.collect()]


def test_stages(spark, tokenizer):
    rows, garbage = documents()
    docs = frame(spark, rows + garbage)
    stages = dict(corpus_pipeline.STAGES)
    assert content(stages["language_id"](spark, docs, "")) == counter(rows)
    check_exact(content(stages["exact_duplicates"](spark, docs, "")), rows + garbage)
    check_near(content(stages["near_duplicates"](spark, docs, "")), rows + garbage)
    assert content(stages["mixture"](spark, docs, "")) == counter(brute_mix(rows + garbage))
    check_packed(stages["packed"](spark, docs, ""), rows + garbage, tokenizer)


def test_stages_of_an_empty_table(spark):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame(spark, []), "")
        assert out.count() == 0 and (name == "packed" or out.columns == DOCS_COLUMNS)


def test_whole_pipeline(spark, tokenizer, tmp_path):
    rows, garbage = documents()
    frame(spark, rows + garbage).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    groups, order = brute_exact(rows)
    left = [min(g, key=order) for g in groups.values()]
    classes, _ = brute_near([(r[0], r[1]) for r in left])
    of = collections.defaultdict(list)
    for r, (c, _) in zip(left, classes):
        of[c].append(r)
    left = [r for c, g in of.items() for r in (g if c is None else [min(g, key=order)])]
    check_packed(out, brute_mix(left), tokenizer)
