import struct

import numpy as np
import pytest

from phrasewell.llm import token_store as T
from phrasewell.llm.common import tokenizer_path


def test_round_trip_of_ids():
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 1000):
        for high in (1, 2, 300, 50_000, 2**31):
            ids = rng.integers(0, high, n).astype(np.uint32)
            if n > 5:
                ids[::17] = high - 1
            out, run, starts, lists = T.pack(ids, np.array([n]))
            assert T.unpack(out.tobytes()) == ids.tolist()
            for k, at in enumerate(starts.tolist()):
                assert T.unpack(out[at:].tobytes()) == ids[128 * k :].tolist()


def test_outliers_cost_little():
    ids = np.full(128, 1000, np.uint32)
    ids[:100] += np.arange(100, dtype=np.uint32) % 8
    ids[5] = 50_000
    out, *_ = T.pack(ids, np.array([128]))
    assert len(out) == 8 + 128 * 3 // 8 + 5


def test_texts_round_trip(spark, documents, odd, prose):
    rows = odd + [(20, "Größe 漢字 🙂 <|endoftext|>"), (21, "  \n\n x\t"), (22, "a" * 5000)]
    rows += [(100 + k, prose.text(k)) for k in range(300)]
    got = T.token_blocks(documents(rows, clashing=True).repartition(2)).collect()
    encode = T.encoding(tokenizer_path(T.VOCABULARY))
    back = sorted(((r["doc_id"], encode.decode(T.unpack(bytes(r["payload"]))), r["n_tokens"], len(r["block_starts"])) for r in got), key=str)
    ids = lambda t: encode.encode_ordinary(t or "")
    assert back == sorted(((i, t or "", len(ids(t)), -(-len(ids(t)) // T.BLOCK)) for i, t in rows), key=str)
    for r in got:
        for at, after in zip(r["block_starts"], [*r["block_starts"][1:], len(r["payload"])]):
            assert 0 < len(T.unpack(bytes(r["payload"][at:after]))) <= T.BLOCK


def test_empty_table_and_missing_vocabulary(documents):
    assert T.token_blocks(documents([])).collect() == []
    with pytest.raises(FileNotFoundError):
        T.encoding("/nowhere/else.tiktoken")


def decode(payload):
    """A reading of the format that the module's docstring states, bit by bit."""
    out, at = [], 0
    while at < len(payload):
        base, width, n_out, count, zero = struct.unpack_from("<IBBBB", payload, at)
        assert zero == 0
        at += 8
        size = (count * width + 7) // 8
        bits = "".join(f"{byte:08b}"[::-1] for byte in payload[at : at + size])
        at += size
        values = [int(bits[k * width : (k + 1) * width][::-1] or "0", 2) for k in range(count)]
        places = payload[at : at + n_out]
        highs = struct.unpack_from(f"<{n_out}I", payload, at + n_out)
        at += 5 * n_out
        for place, high in zip(places, highs):
            values[place] += high * 2**width
        out += [base + v for v in values]
    return out


def test_an_independent_decoder_reads_the_blocks(documents, odd, prose):
    rows = odd + [(20, "Größe 漢字 🙂"), (22, "a" * 5000)] + [(100 + k, prose.text(3 * k)) for k in range(60)]
    encode = T.encoding(tokenizer_path(T.VOCABULARY)).encode_ordinary
    want = {str(i): encode(t or "") for i, t in rows if i is not None}
    widths = set()
    for r in T.token_blocks(documents(rows)).where("doc_id is not null").collect():
        payload = bytes(r["payload"])
        assert decode(payload) == want[str(r["doc_id"])]
        for k, at in enumerate(r["block_starts"]):
            block = want[str(r["doc_id"])][k * T.BLOCK : (k + 1) * T.BLOCK]
            rest = sorted(x - min(block) for x in block)
            # The width is that of the percentile; what needs more is an exception.
            width = rest[-(-len(rest) * 9 // 10) - 1].bit_length()
            assert payload[at + 4] == width and payload[at + 5] == sum(x >= 2**width for x in rest)
            widths.add(width)
    assert len(widths) > 3
