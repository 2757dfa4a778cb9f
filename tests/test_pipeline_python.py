"""End to end against a plain-Python statement of the two-round flow on the
sf0.001 fixture: corpus -> round-1 prompt -> transcript -> parse -> challenge
prompt -> transcript -> parse -> record, for both formats."""

import hashlib
import re

import pytest

from sway.functions import constants as K
from sway.operators import rounds as R
from sway.plans.fixtures import raw_choice_map
from sway.plans.q_rounds import medqa_corpus, responses

SF = "/root/testdata/sf0.001"
SEED = 3407


def sent(s, end="."):
    s = s.strip()
    if s:
        s = s[0].upper() + s[1:]
    if s and s[-1] not in ".!?":
        s += end
    return s


def choice(text, p=K.ANSWER_PATTERN):
    for pat in (p, p.lower()):
        m = re.search(pat + r":?\s+([A-Z]):?", text[text.rfind(pat):])
        if m:
            return m.group(1)
    m = re.search(r"^([A-Z]):", text)
    return m.group(1) if m else ""


def parse_alpaca(tr):
    parts = tr.split("### Response:")
    return choice(parts[1].strip()) if len(parts) > 1 else ""


def parse_chat(tr):
    parts = tr.split("<|start_header_id|>")
    if len(parts) < 3:
        return ""
    m = re.search(r"(?<=\n\n)(.*)", parts[2].strip(), re.DOTALL)
    return choice(m.group(1)) if m else ""


def recall(options, pred):
    hits = re.findall(r"[A-Z]: [^,.]+", options)
    if not pred or pred not in "ABCDEFGH" or len(pred) != 1:
        return ""
    i = "ABCDEFGH".index(pred)
    return hits[i] if i < len(hits) else ""


def who(item_id):
    pool = K.IDENTITY_POOLS["medqa"]
    h = hashlib.md5(f"{SEED}:{item_id}".encode()).hexdigest()
    return pool[int(h[:8], 16) % len(pool)]


def chat_prompt(content):
    return (K.BOS + "<|start_header_id|>user<|end_header_id|>\n\n" + content.strip() + K.EOT
            + "<|start_header_id|>assistant<|end_header_id|>\n\n")


@pytest.fixture(scope="module")
def items(spark):
    out = []
    for r in raw_choice_map(spark, SF).collect():
        opts = dict(r.options)
        if opts.get(r.answer_idx) != r.answer:
            continue
        options = ", ".join(f"{k}: {v}" for k, v in opts.items())
        out.append(dict(item_id=r.item_id, instruction=sent(r.question, "?"), input=sent(options, "."),
                        output=sent(r.answer_idx + ": " + r.answer, "."), resp1=r.resp1, resp2=r.resp2))
    return out


def test_two_round_alpaca_matches_python(spark, items):
    suffix = K.TASK_SUFFIX["medqa"]
    expected = {}
    for it in items:
        t1 = K.ALPACA_INFER.format(instruction=it["instruction"], input=it["input"] + "\n\n" + suffix,
                                   response="") + K.DEFAULT_EOS
        pred = parse_alpaca(K.BOS + t1 + it["resp1"])
        rec = recall(it["input"], pred)
        prev = rec + "\n\n" + suffix if rec else ""
        prefix = K.CHALLENGE_WITH_IDENTITY.format(identity=who(it["item_id"]))
        t2 = prefix + "\n" + K.ALPACA_CHALLENGE.format(instruction=it["instruction"], input=it["input"],
                                                       previous_response=prev, response="") + K.DEFAULT_EOS
        tr2 = K.BOS + t2 + it["resp2"]
        idx, ans = it["output"].split(":", 1)
        expected[it["item_id"]] = (pred, parse_alpaca(tr2), idx.strip(), ans.strip(), tr2)
    qa_resp = responses(raw_choice_map(spark, SF))
    got = R.two_round(medqa_corpus(spark, SF, "alpaca"), "medqa", "alpaca", responses=qa_resp, identity="random",
                      seed=SEED).collect()
    assert len(got) == len(expected)
    for r in got:
        assert (r.pred_idx, r.attack_pred_idx, r.answer_idx, r.answer, r.attack_pred_str) == expected[r.item_id]


def test_two_round_chat_matches_python(spark, items):
    suffix = K.TASK_SUFFIX["medqa"]
    expected = {}
    for it in items:
        human = it["instruction"] + " " + it["input"]
        pred = parse_chat(chat_prompt(human + "\n\n" + suffix) + it["resp1"])
        src = human[human.index("A:"):] if "A:" in human else ""
        prev = recall(src, pred) if src else ""
        content = K.CHALLENGE + "\n\n" + human + "\n\nYour previous response: " + prev + "\n\n" + suffix
        tr2 = chat_prompt(content) + it["resp2"]
        expected[it["item_id"]] = (pred, parse_chat(tr2), tr2)
    qa_resp = responses(raw_choice_map(spark, SF))
    got = R.two_round(medqa_corpus(spark, SF, "sharegpt"), "medqa", "sharegpt", responses=qa_resp).collect()
    assert len(got) == len(expected)
    for r in got:
        assert (r.pred_idx, r.attack_pred_idx, r.attack_pred_str) == expected[r.item_id]


PIECES = ["The correct answer is", "the correct answer is", " ", ": ", "A", "B", "C", "D", "E", "\n", "\n\n", ".",
          "\r", "<|eot_id|>", "x", "### Response:", "12", ",", "Answer:", "C:"]


@pytest.mark.parametrize("fmt", ["alpaca", "sharegpt"])
def test_two_round_random_responses_match_python(spark, items, fmt):
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(11 if fmt == "alpaca" else 12)

    def resp():
        return "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 12)))

    picked = items[:300]
    r = {it["item_id"]: (resp(), resp()) for it in picked}
    rows = [(it["item_id"], rnd_round, text) for it in picked for rnd_round, text in ((1, r[it["item_id"]][0]),
                                                                                       (2, r[it["item_id"]][1]))]
    responses = spark.createDataFrame(rows, "item_id long, round int, response string")
    corpus = medqa_corpus(spark, SF, fmt).join(responses.select("item_id").distinct(), "item_id", "left_semi")
    got = {x.item_id: x for x in R.two_round(corpus, "medqa", fmt, responses=responses,
                                              keys=("item_id",)).collect()}
    suffix = K.TASK_SUFFIX["medqa"]
    assert len(got) == len(picked)
    for it in picked:
        r1, r2 = r[it["item_id"]]
        if fmt == "alpaca":
            t1 = K.ALPACA_INFER.format(instruction=it["instruction"], input=it["input"] + "\n\n" + suffix,
                                       response="") + K.DEFAULT_EOS
            pred = parse_alpaca(K.BOS + t1 + r1)
            rec = recall(it["input"], pred)
            prev = rec + "\n\n" + suffix if rec else ""
            t2 = K.CHALLENGE + "\n" + K.ALPACA_CHALLENGE.format(instruction=it["instruction"], input=it["input"],
                                                                previous_response=prev, response="") + K.DEFAULT_EOS
            attack = parse_alpaca(K.BOS + t2 + r2)
        else:
            human = it["instruction"] + " " + it["input"]
            pred = parse_chat(chat_prompt(human + "\n\n" + suffix) + r1)
            src = human[human.index("A:"):] if "A:" in human else ""
            prev = recall(src, pred) if src else ""
            content = K.CHALLENGE + "\n\n" + human + "\n\nYour previous response: " + prev + "\n\n" + suffix
            attack = parse_chat(chat_prompt(content) + r2)
        g = got[it["item_id"]]
        assert (g.pred_idx, g.attack_pred_idx) == (pred, attack), (r1, r2)
