import hashlib
import random

from meridian.llm.chat_format import CLOSE, FOREIGN, NEXT, OPEN, digest, format_chats

SCHEMA = "conv_id long, turn long, role string, text string, turns string, formatted int, n long"


def hexed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip_of_hostile_texts(spark):
    rnd = random.Random(2)
    parts = ["<", "|", "%", "%3C", "%25", "%5B", "end|>", "a", "\n", "é😀", OPEN, NEXT, CLOSE, "<|says|>", *FOREIGN, "<|en", "", " "]
    rows = []
    for conv in range(60):
        for turn in range(rnd.randint(1, 9)):
            text = None if rnd.random() < 0.1 else "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
            rows.append((conv, turn, rnd.choice(["user", "assistant", "assistant", "system", "<|end|>", None]), text, "x", 1, 2))
    rows += [(None, 0, "user", "hi", "x", 1, 2), (99, 1, "user", "b", "x", 1, 2), (99, 1, "user", "b", "x", 1, 2), (99, None, "assistant", "z", "x", 1, 2)]
    rnd.shuffle(rows)
    formatted = format_chats(spark.createDataFrame(rows, SCHEMA))
    found = {r.conv_id: r for r in digest(formatted).collect()}
    texts = {r.conv_id: r for r in formatted.collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((-1 if t is None else t, r or "", x or "") for c, t, r, x, *_ in rows if c == conv)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hexed("".join(f"{a}\n{x}\n" for _, a, x in turns)))
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(loss), hexed(loss), len(texts[conv].formatted))
        blocks = 1 + sum(a[1] != b[1] for a, b in zip(turns, turns[1:]))
        assert texts[conv].formatted.count(OPEN) == texts[conv].formatted.count(CLOSE) == blocks
        assert texts[conv].formatted.count(NEXT) == len(turns) - blocks
        assert not any(x in texts[conv].formatted for x in FOREIGN)


def test_empty_table(spark):
    assert digest(format_chats(spark.createDataFrame([], SCHEMA))).count() == 0
