"""Token counts, conversation repair and fill-in-the-middle against their libraries and brute force."""

import hashlib
import itertools
import random
import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

from compare import same
from glossweave.llm import fill_middle, queries, role_repair, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, n_tokens string, form string, row string, output string, `N` string"
ODD = [(1, "a b c d e"), (2, None), (3, ""), (None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (5, "x" * 30_000), (6, "é 🙂   <|endoftext|>"), (7, " \n\t "), (8, "lorem ipsum dolor sit amet " * 5000), (9, "a <S> b"), (10, "<|endoftext|>x<|endoftext|>")]


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "c", "f", "r", "o", "n") for i, t in rows], DOCS).repartition(parts)


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


# --- token counts


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_of_odd_rows(spark, name):
    count = library(name)
    got = sorted((tuple(r) for r in token_counts.count_tokens(docs(spark, ODD), public_tokenizers.path(name), limit=4).collect()), key=repr)
    want = [(i, len((t or "").encode()), count(t or ""), count(t or "") > 4) for i, t in ODD]
    assert got == sorted(want, key=repr)
    assert token_counts.count_tokens(docs(spark, []), public_tokenizers.path(name)).count() == 0


def test_counts_by_sentencepiece(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs(spark, [(1, "Hello world"), (2, None), (3, "é 🙂")]), path).collect()}
    assert got == {1: len(model.encode("Hello world")), 2: 0, 3: len(model.encode("é 🙂"))}


def test_counts_of_random_texts(monkeypatch):
    path, r = public_tokenizers.path("byte_bpe_50k.json"), random.Random(3)
    count, counts = library("byte_bpe_50k.json"), token_counts.Counts(path)
    assert counts.library is None  # merged by arrays
    for letters in ("ab Z'sre\n\t 0½²é×_.,!  ́中🙂\x1c\x85", "a 'srevmtld\n\t9.x", "aaaab", "thequickbrownfox", "的一是不了人我在有他", ["<|endoftext|>", "a", " ", "'s"]):
        texts = ["".join(r.choices(letters, k=r.randint(0, 60))) for _ in range(300)]
        want = [count(t) for t in texts]
        for long in (1 << 12, 8):
            monkeypatch.setattr(token_counts, "LONG", long)
            counts.memo.clear()
            assert counts.of(texts).tolist() == want


def test_counts_of_long_matches():
    path, r = public_tokenizers.path("byte_bpe_50k.json"), random.Random(5)
    count, counts = library("byte_bpe_50k.json"), token_counts.Counts(path)
    for text in ("x" * 50_001, "ab" * 20_000, "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=40_000)), "".join(r.choices("的一是不了人我在", k=20_000))):
        assert counts.of([text, "a b", text[:5000]]).tolist() == [count(text), 2, count(text[:5000])]


def test_merges_out_of_order_are_left_to_the_library(tmp_path):
    import json

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        file = json.load(f)
    file["model"]["merges"].reverse()
    path = tmp_path / "odd.json"
    path.write_text(json.dumps(file), encoding="utf-8")
    assert token_counts.Counts(str(path)).library is not None


def test_op11_against_the_library(spark):
    count = library("byte_bpe_50k.json")
    want = {r.doc_id: (len((r.text or "").encode()), count(r.text or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_token_counts(spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got.collect()} == want and all(r.over_limit == (r.n_tokens > 1024) for r in got.collect())


# --- conversation repair

WORDS = ["", " ", "one.", "two", "three!", "four? \n", "one."]


def by_all_edits(turns):
    """The least (cost, audit) and its repair, by trying every sequence of edits: K, R, D a turn and I between, to few insertions."""
    best, seen, faults = None, set(), []
    for role, text in turns:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    for kinds in itertools.product("DKR", repeat=len(turns)):
        if any(k != "D" and f in ("blank", "duplicate") for k, f in zip(kinds, faults)):
            continue
        for gaps in itertools.product(range(3), repeat=len(turns) + 1):
            edits = "".join("I" * g + k for g, k in zip(gaps, kinds)) + "I" * gaps[-1]
            cost = sum({"D": 4, "K": 0, "R": 3, "I": 3}[e] for e in edits) + sum(3 for k, f in zip(kinds, faults) if k != "D" and f == "truncated")
            if best and (cost, edits) >= best[:2]:
                continue
            out, rows, fits = [], iter(turns), True
            for e in edits:
                role, text = ("", "") if e == "I" else next(rows)
                if e == "D":
                    continue
                if not out and e == "K" and role[:1] == "s":
                    out.append((role, text))
                    continue
                due = "user" if len([x for x in out if x[0][:1] != "s" or x is not out[0]]) % 2 == 0 else "assistant"
                if e == "K" and role[:1] != due[0]:
                    fits = False
                    break
                out.append((role if e == "K" else due, text))
            body = out[1:] if out and out[0][0][:1] == "s" else out
            if fits and len(body) % 2 == 0 and (body or not out):
                best = (cost, edits, "\n".join(f"{a}:{b}" for a, b in out))
    return best, faults


def test_parse_against_all_edits():
    r = random.Random(7)
    for _ in range(120):
        turns = [(r.choice(["user", "assistant", "system", " ", "umbra"]), r.choice(WORDS)) for _ in range(r.randint(0, 4))]
        (cost, audit, _), faults = by_all_edits(turns)
        kinds = {"": role_repair.SOUND, "blank": role_repair.BLANK, "duplicate": role_repair.DUPLICATE, "truncated": role_repair.TRUNCATED}
        column = role_repair.parse([(a[:1], kinds[f]) for (a, _), f in zip(turns, faults)], role_repair.CHAT, "Start")
        assert min(column[e] for e in role_repair.CHAT.ends if e in column)[:2] == (cost, audit)


CHATS = "conv_id long, turn long, role string, text string, place string, block string, audit string"


def chats(spark, rows):
    return spark.createDataFrame([(*r, "p", "b", "a") for r in rows], CHATS).repartition(3)


@pytest.mark.parametrize("block", [256, 2, 3])
def test_repair_in_blocks(spark, monkeypatch, block):
    """Blocks as small as this need several levels."""
    monkeypatch.setattr(role_repair, "BLOCK", block)
    r, rows = random.Random(block), []
    for conv in (None, 1, 2, 3, 4, -(2**63)):
        rows += [(conv, t if r.random() < 0.9 else None, r.choice(["user", "assistant", "system", None]), r.choice([*WORDS, None])) for t in range(r.randint(1, 5))]
    rows += [(5, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(60) if t != 31]
    rows += [(6, 7, "user", "same.")] * 9
    found = role_repair.repair(chats(spark, rows))
    report = {x.conv_id: x for x in found.report.collect()}
    digest = {x.conv_id: x["sha256"] for x in found.digests.collect()}
    turns = {}
    for x in sorted(found.turns.collect(), key=lambda x: (x.place, x.step)):
        turns.setdefault(x.conv_id, []).append(f"{x.role}:{x.text}")
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn is not None, turn, " " if role is None else role, " " if text is None else text))
    assert set(report) == set(by_conv)
    for conv, said in by_conv.items():
        said.sort(key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        numbers = [x[1] for x in said if x[0]]
        got = report[conv]
        assert got.gaps == (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0)
        assert got.illegal == sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        if conv == 5:
            assert (got.cost, got.audit) == (3, "K" * 31 + "I" + "K" * 28)
        elif conv == 6:
            assert (got.cost, got.audit, got.duplicate) == (35, "KDDDDDDDDI", 8)
        else:
            (cost, audit, repaired), faults = by_all_edits([x[2:] for x in said])
            assert (got.cost, got.audit) == (cost, audit)
            assert [got.blank, got.duplicate, got.truncated] == [faults.count(k) for k in ("blank", "duplicate", "truncated")]
            assert "\n".join(turns.get(conv, [])) == repaired
        if conv in turns:
            assert digest[conv] == hashlib.sha256("\n".join(turns[conv]).encode()).hexdigest()
        else:
            assert conv not in digest


def test_repair_of_nothing(spark):
    found = role_repair.repair(chats(spark, []))
    assert [t.count() for t in found] == [0, 0, 0]


def test_repair_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(role_repair, "PIECE", 100)
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t} " * 50_000 + ".") for t in range(6)]
    got = role_repair.repair(chats(spark, rows)).digests.first()
    assert got["sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in rows).encode()).hexdigest()


# --- fill in the middle


def cut(doc_id, text):
    """The transformation of one text in plain Python."""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(spark):
    r = random.Random(1)
    rows = ODD + [(k, "".join(r.choices(["a", "<", "<P", "S>", ">", " ", "\n", "é", "🙂", " ", "M>"], k=r.randint(0, 30)))) for k in range(20, 400)]
    found = fill_middle.fill_in_middle(docs(spark, rows))
    assert found.columns[:7] == ["doc_id", "text", "n_tokens", "form_carried", "row", "output_carried", "N_carried"]
    got = sorted(((x.doc_id, x.text, x[7], x.form, x.prefix_chars, x.middle_chars, x.output) for x in found.collect()), key=repr)
    assert got == sorted(((i, t, *cut(i, t)) for i, t in rows), key=repr)
    assert {"plain", "spm", "psm"} == {x[3] for x in got}
    whole = found.select(F.coalesce("text", F.lit("")).alias("text"), fill_middle.restored(F.col("output"), F.col("form")).alias("back"))
    assert whole.where("text <> back").count() == 0
    assert fill_middle.fill_in_middle(docs(spark, [])).count() == 0


def test_fill_in_middle_stays_on_the_jvm(spark):
    plan = queries.op13_fill_middle(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


@pytest.mark.parametrize("name", ["op12_role_repair", "op13_fill_middle"])
def test_against_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, SF), duck, queries.ORACLES[name])
