"""Packing, manifest and filter audit against brute force, and on odd rows."""

import hashlib
import random
from itertools import permutations
from zlib import crc32

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plotweave.llm.audit import interactions, lehmer_rank, mask_counts, removal_intervals
from plotweave.llm.merkle import build_manifest, folded, leaf_digest, proof_digest, proofs
from plotweave.llm.packing import OpenBins, encoder, ids_crc32, pack_sequences
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def checked_packing(packed, texts, size):
    """Every piece of every document is there, in gapless sequences; returns the number of sequences and the least possible one."""
    tokenizer = Tokenizer.from_file(PATH)
    rows = packed.withColumn("crc", ids_crc32(F.col("ids"))).collect()
    want = []
    for doc, text in texts:
        ids = ids_of(tokenizer, text)
        want += [(str(doc), i, at, len(ids[at:at + size]), crc32(ids[at:at + size].tobytes())) for i, at in enumerate(range(0, len(ids), size))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.crc) for r in rows) == sorted(want)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= size
    return len(places), -(-sum(r.length for r in rows) // size)


def test_packing_of_documents(docs, texts):
    packed, least = checked_packing(pack_sequences(docs, PATH), texts.items(), 2048)
    assert packed <= least + 2


def test_packing_in_rounds(docs, texts):
    """Few open bins and many tasks: bins left open travel through several rounds, whole."""
    packed, least = checked_packing(
        pack_sequences(docs.repartition(24, "doc_id"), PATH, size=512, open_bins=4, read_ahead=8, round_factor=3), texts.items(), 512)
    assert packed <= 1.1 * least


def test_packing_of_odd_rows(odd, none):
    checked_packing(pack_sequences(odd, PATH, size=64), [(r[0], r[1]) for r in ODD], 64)
    assert pack_sequences(none, PATH).count() == 0


def test_ids_are_those_of_whole_texts(texts):
    with open(PATH, encoding="utf-8") as file:
        vocabulary = file.read()
    encode, tokenizer = encoder(vocabulary), Tokenizer.from_str(vocabulary)
    odd = ["It's THE end''s 'lla 12ab3 İSTANBUL ΟΔΟΣ ΟΔΟΣ. é ́x a b a b \x1c\x1d x\x85y <|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b",
           "́ ̧́ é é", "".join(map(chr, range(0xa0, 0x250))), " ".join(map(chr, range(0x20, 0x250))), "L'ÉTÉ's où's œuf ŒUF ŉ ŉs ĳ ſ İı", "x" * 3000, "ß ẞ ﬁ Ⅳ ½ 𝒳 \U0001f600‍", "", " \n\t", "a\x00b \x7f ~!@#"]
    for text in [*odd, *texts.values()]:
        assert encode(text.encode()) == ids_of(tokenizer, text)[:-1].tobytes(), text[:80]


def test_bins_against_a_plain_search():
    """The bitset finds the bin that a search of all open bins finds."""
    chance = random.Random(5)
    for limit in (1, 3, 40):
        bins, open_, closed = OpenBins(100, limit), [], []
        for i in range(2000):
            length = chance.choice((1, 7, 33, 50, 51, 90, 100, chance.randint(1, 100)))
            got = bins.place(length, (i, length))
            fits = [b for b in open_ if 100 - sum(x for _, x in b) >= length]
            want = []
            if fits:
                space = min(100 - sum(x for _, x in b) for b in fits)
                into = [b for b in fits if 100 - sum(x for _, x in b) == space][-1]
                open_.remove(into)
            else:
                if len(open_) == limit and length < 100:
                    most = max(sum(x for _, x in b) for b in open_)
                    want.append([b for b in open_ if sum(x for _, x in b) == most][-1])
                    open_.remove(want[0])
                into = []
            into.append((i, length))
            (want if sum(x for _, x in into) == 100 else open_).append(into)
            assert got == want
            closed += got
        assert sorted(map(tuple, bins.rest())) == sorted(map(tuple, open_)) and len(open_) <= limit


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climbed(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def path_of(levels, at):
    path = []
    for level in levels[:-1]:
        run = level[at // 16 * 16:at // 16 * 16 + 16]
        path.append(("".join(run[:at % 16]), "".join(run[at % 16 + 1:])))
        at //= 16
    return path


def brute_manifest(leaves):
    """(key, id, leaf) to the proofs of each leaf, and the root."""
    by_key = {}
    for key, doc, leaf in leaves:
        by_key.setdefault(key, []).append((doc is not None, doc or 0, leaf))
    keys = sorted(by_key, key=lambda k: (k is not None, (k or "").encode()))
    trees = [climbed([x[2] for x in sorted(by_key[k])]) for k in keys]
    top = climbed([t[-1][0] for t in trees])
    proofs_ = []
    for i, (k, tree) in enumerate(zip(keys, trees)):
        for at, (_, doc, leaf) in enumerate(sorted(by_key[k])):
            path = path_of(tree, at) + path_of(top, i)
            proofs_.append((k, leaf, tree[-1][0], sha("".join(a + b for a, b in path))))
    return sorted(proofs_, key=str), top[-1][0]


def manifest_rows(found):
    return sorted(((r.key, r.digest, r.subroot, r.proof) for r in found.withColumn("proof", proof_digest(F.col("path"))).collect()), key=str)


def test_manifest_of_groups_of_any_size(llm):
    """Groups of 1, 16, 17, 300 and 4,100 leaves, a null key, null and repeated ids; more than 16 groups, so that their roots make a tree as well."""
    sizes = {"big": 4100, "é": 300, "run": 16, "over": 17, None: 40, **{f"one{i}": 1 for i in range(30)}}
    leaves = [(k, i // 2 if k == "over" else None if k is None else i * 7 % 5000, sha(f"{k}/{i}")) for k, n in sizes.items() for i in range(n)]
    leaves += [("run", None, sha("same"))] * 40
    df = llm.createDataFrame(leaves, "source STRING, doc_id BIGINT, leaf STRING").repartition(7)
    manifest = build_manifest(df, "source", ["doc_id"])
    want, root = brute_manifest(leaves)
    found = proofs(manifest)
    assert manifest_rows(found) == want and {r.root for r in found.select("root").distinct().collect()} == {root}
    assert found.where(folded(F.col("digest"), F.col("path")) != F.col("root")).count() == 0
    assert found.where(folded(F.sha2("digest", 256), F.col("path")) == F.col("root")).count() == 0
    some = found.where("doc_id % 97 = 3 OR key = 'one4'").select("doc_id").distinct()
    few = proofs(manifest, some)
    ids = {r.doc_id for r in some.collect()}
    assert manifest_rows(few) == manifest_rows(found.where(F.col("doc_id").isin(ids)))


def test_manifest_of_odd_rows(odd, none):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaves = lambda df: df.select("doc_id", "source", leaf_digest(*fields).alias("leaf"))
    want, root = brute_manifest([(r.source, r.doc_id, r.leaf) for r in leaves(odd).collect()])
    found = proofs(build_manifest(leaves(odd), "source", ["doc_id"]))
    assert manifest_rows(found) == want and found.first().root == root
    null = [r for r in found.collect() if r.doc_id == 2][0]
    assert null.digest == sha("1:2----")
    assert proofs(build_manifest(leaves(none), "source", ["doc_id"])).count() == 0
    alone = proofs(build_manifest(leaves(odd.where("doc_id = 6")), "source", ["doc_id"])).first()
    assert alone.digest == alone.subroot == alone.root and alone.path == []


def test_intervals_cover_every_order_once():
    orders = ["".join(p) for p in permutations("ABCDE")]
    assert [lehmer_rank(o) for o in orders] == list(range(120))
    step_of = {}
    for mask, step, low, high in removal_intervals():
        for rank in range(low, high):
            assert (mask, rank) not in step_of
            step_of[mask, rank] = step
    for mask in range(1, 32):
        failed = {c for i, c in enumerate("ABCDE") if mask >> i & 1}
        assert all(step_of[mask, rank] == min(o.index(c) for c in failed) + 1 for rank, o in enumerate(orders))


def brute_audit(docs, labels):
    first = {}
    for doc, text, _ in docs:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    found = {}
    for doc, text, lang in docs:
        t = text or ""
        words = [w for w in t.translate({c: 32 for c in range(9, 14)}).split(" ") if w]
        fails = {c for c, f in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            any(c in "#$%&*|" for c in t), doc is not None and doc > first[t])) if f}
        found.setdefault(lang or "", []).append((fails, *labels.get(doc, (0, 0))))
    rows = []
    for part, members in found.items():
        steps = []
        for order in map("".join, permutations("ABCDE")):
            alive = members
            for step, f in enumerate(order, 1):
                gone = [m for m in alive if f in m[0]]
                alive = [m for m in alive if f not in m[0]]
                redundant = sum(f in m[0] for m in members) - len(gone)
                steps.append((order, step, len(alive), len(gone), redundant, sum(m[0] == {f} for m in members), sum(m[1] for m in gone), sum(m[2] for m in gone)))
        shapley = {f: sum(s[3] for s in steps if s[0][s[1] - 1] == f) for f in "ABCDE"}
        rows += [(part, *s, shapley[s[0][s[1] - 1]]) for s in steps]
    return sorted(rows)


def test_audit_of_odd_rows(llm, odd, none):
    labels = [(1, 1, 0), (1, 0, 1), (7, 1, 1), (None, 1, 1), (5, None, None), (999, 1, 1)]
    marks = llm.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT")
    got = sorted(map(tuple, interactions(mask_counts(odd, marks)).collect()))
    assert got == brute_audit([r[:3] for r in ODD], {1: (1, 1), 7: (1, 1)})
    assert interactions(mask_counts(none, marks)).count() == 0
    assert interactions(mask_counts(odd, marks.limit(0))).where("good_lost > 0").count() == 0
