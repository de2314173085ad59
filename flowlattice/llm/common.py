"""Small helpers shared by the operators of this subpackage."""

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from flowlattice.session import materialized  # noqa: F401  (re-exported: tables in the shared folder)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def batches_of(spark, rows):
    """Actions inside hand rows to Python in batches of at most so many, as whole texts and sets are long."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


_HELD, _ASKED = {}, [False]


def held(name, build):
    """What `build` makes, held in this Python process until something else is asked for, or a task ends that asked for nothing.

    Spark's Python workers live on from task to task, so words, models and tokenizers are kept between the tasks of a stage, but
    those of an earlier stage are let go.
    """
    _ASKED[0] = True
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = build()
    return _HELD[name]


def let_go():
    """Free what `held` holds, before a stage that needs none of it."""
    _HELD.clear()


class Recent(dict):
    """What was worked out, bounded: when `limit` entries are exceeded they become the older generation, and the one before them goes."""

    def __init__(self, limit):
        super().__init__()
        self.limit, self.older = limit, {}

    def recall(self, key):
        """An entry of the older generation, moved on to this one; None if there is none."""
        value = self.older.get(key)
        if value is not None:
            self[key] = value
        return value

    def tidy(self):
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()


def give_back():
    """Return freed memory of Arrow and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries cannot
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def frugal():
    """Around the work of a task: what it did not ask for is let go, and what was freed goes back to the system.

    Workers wait for their next task with all that they ever held otherwise.
    """
    _ASKED[0] = False
    try:
        yield
    finally:
        if not _ASKED[0]:
            let_go()
        give_back()


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc_is(column, modulus, remainder):
    """Whether crc32 of the id as text leaves this remainder; a null id never does."""
    crc = F.crc32(F.col(column).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(modulus)) == remainder, F.lit(False))


def ascii_lower_words(text):
    """Words between ASCII white space, A-Z lower-cased, as UTF-8 bytes; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def distinct_words(column, unless=None):
    """(words, codes, bounds) of an Arrow column of texts: its distinct words as bytes, the word at each place, and the rows' bounds
    among the places.

    Words lie between ASCII white space, A-Z lower-cased but in texts that contain `unless`; null has none. Arrow cuts and numbers them,
    so Python sees every word of a batch once.
    """
    texts = pc.fill_null(column, "")
    lower = pc.ascii_lower(texts)
    if unless is not None:
        lower = pc.if_else(pc.match_substring(texts, unless), texts, lower)
    cut = pc.ascii_split_whitespace(lower)
    numbered = cut.values.dictionary_encode()
    words = numbered.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    codes, bounds = numbered.indices.to_numpy(), cut.offsets.to_numpy()
    if b"" in words:  # white space at an end leaves an empty word there
        there = codes != words.index(b"")
        bounds, codes = np.append(0, np.cumsum(there))[bounds], codes[there]
    return words, codes, bounds


def arrow_schema(schema):
    """(Spark schema, Arrow schema) of a DDL string or a Spark schema."""
    struct = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    return struct, to_arrow_schema(struct)


BATCH_ROWS, BATCH_BYTES, ARROW_ROWS = 256, 1 << 23, 1024


def slices(batch, size=BATCH_BYTES, most=BATCH_ROWS):
    """A batch in slices of at most `most` rows (`ARROW_ROWS` where texts stay in Arrow) and, but for single rows, about `size` bytes.

    Texts become Python objects a slice at a time, so a worker's memory follows the longest texts and not the batch.
    """
    low = 0
    while low < batch.num_rows:
        rows = min(most, batch.num_rows - low)
        while rows > 1 and batch.slice(low, rows).nbytes > size:
            rows = -(-rows // 4)
        yield batch.slice(low, rows)
        low += rows


def each(column):
    """The values of an Arrow column one by one, without a list of all."""
    return (value.as_py() for value in column)


def add_columns(frame, needs, step, made, carry):
    """The columns `carry` of `frame` as they are, then those that `step` makes of the lists of column `needs`.

    Only the named columns are read, so other columns may have any name; one in `carry` gives way to a made one
    of the same name. `needs` is a column or a tuple of them.
    """
    needs = (needs,) if isinstance(needs, str) else needs
    struct, arrow = arrow_schema(made)
    carry = [c for c in dict.fromkeys(carry) if c not in struct.names]
    read = frame.select(*dict.fromkeys([*carry, *needs]))
    whole, whole_arrow = arrow_schema(StructType([read.schema[c] for c in carry] + struct.fields))

    def run(batches):
        with frugal():
            for batch in batches:
                for part in slices(batch):
                    columns = step({name: part.column(name).to_pylist() for name in needs})
                    arrays = [part.column(c).cast(whole_arrow.field(c).type) for c in carry]
                    arrays += [pa.array(columns[field.name], type=field.type) for field in arrow]
                    yield pa.RecordBatch.from_arrays(arrays, schema=whole_arrow)

    return read.mapInArrow(run, whole)


def map_rows(frame, step, schema):
    """`mapInArrow` over lists: `step(columns)` takes and returns a dict of lists, one call per slice of a batch."""
    struct, arrow = arrow_schema(schema)

    def run(batches):
        with frugal():
            for batch in batches:
                for part in slices(batch):
                    made = step({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(made[field.name], type=field.type) for field in arrow], schema=arrow)

    return frame.mapInArrow(run, struct)
