import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.functions.codec import CorruptData, Footer, Handle
from lodestrata.operators.blocks import DataBlockBuilder, DataBlockReader, IndexBlockBuilder, IndexBlockReader
from lodestrata.sources.sorted_table import TableBuilder, TableFile

FRUIT = [(b"apple", b"A"), (b"apples", b"AA"), (b"apply", b"AAA"), (b"banana", b"B"), (b"carrot", b"C"), (b"carrots", b"CC")]


def block(pairs, interval=16):
    b = DataBlockBuilder(interval)
    for k, v in pairs:
        b.add(k, v)
    return b


def test_data_block_bytes_and_lookups():
    built = block(FRUIT, 2)
    assert built.current_size() == 122
    data = built.finish()
    assert len(data) == built.current_size() == 122
    assert data == built.finish()
    reader = DataBlockReader(data)
    assert reader._restarts == [0, 33, 72]
    assert list(reader) == FRUIT
    assert all(reader.get(k) == v for k, v in FRUIT)
    assert [reader.get(k) for k in (b"appl", b"blueberry", b"zzz", b"")] == [None] * 4


def test_entry_layout():
    data = block(FRUIT, 2).finish()
    assert data[18:30] == bytes([5, 0, 0, 0, 1, 0, 0, 0, 2, 0, 0, 0])


def test_index_routes_to_the_floor():
    b = IndexBlockBuilder()
    for k, h in ((b"apple", Handle(0, 111)), (b"banana", Handle(200, 222)), (b"carrot", Handle(500, 333))):
        b.add(k, h)
    data = b.finish()
    assert data == b.finish()
    reader = IndexBlockReader(data)
    found = [reader.find(k) for k in (b"aardvark", b"apple", b"apricot", b"banana", b"blueberry", b"carrot", b"zzz")]
    assert [h and h.offset for h in found] == [None, 0, 0, 200, 200, 500, 500]
    assert IndexBlockReader(IndexBlockBuilder().finish()).find(b"x") is None


def test_order_and_finish_errors():
    b = DataBlockBuilder()
    b.add(b"a", b"1")
    with pytest.raises(ValueError, match="increase"):
        b.add(b"a", b"2")
    b.finish()
    with pytest.raises(ValueError, match="finished"):
        b.add(b"b", b"2")
    i = IndexBlockBuilder()
    i.add(b"b", Handle(0, 1))
    with pytest.raises(ValueError, match="increase"):
        i.add(b"a", Handle(1, 1))
    with pytest.raises(ValueError, match="interval"):
        DataBlockBuilder(0)
    e = DataBlockBuilder()
    e.add(b"", b"")
    with pytest.raises(ValueError, match="increase"):
        e.add(b"", b"")


def test_corruption_raises():
    for reader in (DataBlockReader, IndexBlockReader):
        with pytest.raises(CorruptData):
            reader(b"abc")
    with pytest.raises(CorruptData):
        DataBlockReader(block([(b"a", b"1")]).finish()[:-5]).get(b"a")
    i = IndexBlockBuilder()
    i.add(b"a", Handle(0, 1))
    with pytest.raises(CorruptData):
        IndexBlockReader(i.finish()[:-4] + (1000).to_bytes(4, "little"))
    with pytest.raises(CorruptData):
        DataBlockReader((0).to_bytes(4, "little"))


@given(st.dictionaries(st.binary(max_size=12), st.binary(max_size=20), min_size=1, max_size=60), st.integers(1, 20), st.lists(st.binary(max_size=12), max_size=10))
@settings(max_examples=100)
def test_block_is_a_sorted_dict(pairs, interval, probes):
    reader = DataBlockReader(block(sorted(pairs.items()), interval).finish())
    assert dict(reader) == pairs
    assert all(reader.get(k) == pairs.get(k) for k in [*pairs, *probes])


def build_file(pairs, **options):
    out = bytearray()
    b = TableBuilder(out.extend, **options)
    for k, v in pairs:
        b.add(k, v)
    b.finish()
    return bytes(out)


def opened(data):
    return TableFile(lambda at, n: data[at : at + n], len(data))


def test_file_of_two_keys():
    data = build_file([(b"key1", b"value1"), (b"key2", b"value2")], filter_rate=None)
    assert len(data) == 118
    assert data[-40:] == Footer(Handle(0, 0), Handle(49, 29)).encode()
    assert opened(data).get(b"key1") == b"value1"


def test_file_of_many_blocks():
    rng = random.Random(4)
    pairs = sorted({bytes(rng.choices(range(256), k=rng.randint(0, 9))): bytes([i % 256]) for i in range(3000)}.items())
    table = opened(build_file(pairs, block_bytes=512))
    assert len(table.index.handles) > 20
    assert all(table.get(k) == v for k, v in pairs)
    assert table.get(b"\xff" * 12) is None
    assert table.bloom is not None


def test_empty_and_damaged_files():
    assert opened(build_file([])).get(b"a") is None
    data = build_file([(b"a", b"1")])
    with pytest.raises(CorruptData):
        opened(data[:-1])
    with pytest.raises(CorruptData):
        opened(b"short")
