"""FASTA and vector files on any file system that Hadoop knows, by Spark's own text reader and writer.

    read_fasta(spark, "/data/reads")          # file, folder or pattern; .gz, .bz2 ... are unpacked by their names

Files are read in splits of spark.sql.files.maxPartitionBytes. By default the text reader cuts at line starts with '>', so that each record is one value. With chunk_letters
it cuts at lines, and a chromosome comes as overlapping chunks with offsets, never as one value: only the first and the last record of a split may be parts of
longer ones, and these few are brought together by the order of the splits in their file.
"""

from __future__ import annotations

import gzip
import os
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.sources.shared import file_system, materialise, width

PIECES = "file string, block bigint, record bigint, title string, seq string, offset bigint, open boolean"
ZEROS = 65_536  # lines of a gap that are written as one value


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file, folder or pattern names anything; names that start with '.' or '_' and empty files in folders don't count."""
    fs, p = file_system(spark, path)
    inside = (s for f in fs.globStatus(p) or [] for s in (fs.listStatus(f.getPath()) if f.isDirectory() else [f]))
    return any(s.getLen() > 0 and s.getPath().getName()[0] not in "._" for s in inside)


def _letters(lines: pa.Array) -> tuple[memoryview, list[int]]:
    """The lines without spaces, CRs and white space at their ends, as one buffer, and where in it each line begins."""
    clean = pc.replace_substring(pc.replace_substring(pc.ascii_rtrim_whitespace(lines), " ", ""), "\r", "")
    offsets = clean.cast(pa.large_binary())
    ends = memoryview(offsets.buffers()[1]).cast("q")[offsets.offset : offsets.offset + len(offsets) + 1].tolist()
    return memoryview(offsets.buffers()[2] or b""), ends


def _pieces(chunk: int, overlap: int):
    """Lines (value, file, block) -> pieces of records: a record has number 0, 1 ... in its split, letters before the first title have -1;
    `open` marks what may go on in the next split or come from the one before. Each split gives at least its piece -1, maybe without letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, record, title, held, size, offset = None, -1, None, [], 0, 0
        out: list[tuple] = []
        made = 0

        def put(last: bool) -> None:
            nonlocal held, size, offset, made
            whole = b"".join(held)
            while chunk and len(whole) > chunk:
                out.append((*place, record, title, whole[:chunk].decode("utf-8", "replace"), offset, True))
                made += chunk
                whole, offset = whole[chunk - overlap :], offset + chunk - overlap
            if last:
                out.append((*place, record, title, whole.decode("utf-8", "replace"), offset, True))
                made += len(whole)
                held, size, offset = [], 0, 0
            else:
                held, size = [whole], len(whole)

        def flush() -> pa.RecordBatch:
            nonlocal out, made
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
            b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.strip().split(" ")[0] for x in PIECES.split(",")])
            out, made = [], 0
            return b

        def settle() -> None:
            """The record is at its end, and not the last of its split."""
            first = len(out)
            put(True)
            for i in range(first, len(out)):
                out[i] = (*out[i][:6], record < 0)

        for b in batches:
            if not b.num_rows:
                continue
            files, blocks = b.column(1).to_pylist(), b.column(2).to_pylist()
            titles = pc.starts_with(b.column(0), ">").to_pylist()
            text, at = _letters(b.column(0))
            i = 0
            while i < b.num_rows:
                if (files[i], blocks[i]) != place:
                    if place is not None:
                        put(True)
                    place, record, title = (files[i], blocks[i]), -1, None
                if titles[i]:
                    settle()
                    raw = b.column(0).slice(i, 1).cast(pa.binary())[0].as_py()
                    title, record = raw[1:].rstrip().decode("utf-8", "replace"), record + 1
                    i += 1
                    continue
                j = i
                while j < b.num_rows and not titles[j] and files[j] == place[0] and blocks[j] == place[1]:
                    j += 1
                held.append(bytes(text[at[i] : at[j]]))
                size += at[j] - at[i]
                if chunk and size > chunk:
                    put(False)
                i = j
                if made > 1 << 24:
                    yield flush()
        if place is not None:
            put(True)
        if out:
            yield flush()

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text between line starts with '>' (value, file, block, size of the file) -> (title, seq). The first one of a file is a record only if it has the '>' still."""
    place = None
    for b in batches:
        for low in range(0, b.num_rows, 500):
            part = b.slice(low, 500)
            titles, seqs = [], []
            for value, file, block, size in zip(*(part.column(i).cast(pa.binary()).to_pylist() if i == 0 else part.column(i).to_pylist() for i in range(4))):
                first, place = block == 0 and (file, block) != place, (file, block)
                if first:
                    if value[:1] != b">":
                        if len(value) >= size - 1:
                            raise ValueError(f"no title line in the FASTA file {file}")
                        continue
                    value = value[1:]
                title, _, body = value.partition(b"\n")
                if any(x in body for x in (b"\t", b"\v", b"\f")):
                    body = re.sub(rb"\s+(?=\n|\Z)", b"", body)
                titles.append(title.rstrip().decode("utf-8", "replace"))
                seqs.append(body.translate(None, b" \r\n").decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(titles, pa.string()), pa.array(seqs, pa.string())], names=["title", "seq"])


def read_fasta(spark: SparkSession, path: str, chunk_letters: int = 0, overlap: int = 0) -> DataFrame:
    """(title, ref, seq, offset) of each record, or of each chunk of at most chunk_letters, whose neighbours share `overlap` letters (k - 1 for k-mers); where
    splits of a file meet, chunks are shorter. Text before the first title of a file is left out; a file with text but no title is an error, and so is a path with
    nothing to read. Empty files of a folder are passed over."""
    if chunk_letters and overlap >= chunk_letters:
        raise ValueError("overlap must be less than chunk_letters")
    if not exists(spark, path):
        raise FileNotFoundError(f"nothing to read at {path}")
    file, block = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    if not chunk_letters:
        text = spark.read.text(path, lineSep="\n>").select("value", file, block, F.col("_metadata.file_size").alias("size"))
        out = text.mapInArrow(_whole, "title string, seq string").withColumn("offset", F.lit(0).cast("bigint"))
    else:
        lines = spark.read.text(path, lineSep="\n").select("value", file, block)
        pieces = materialise(lines.mapInArrow(_pieces(chunk_letters, overlap), PIECES), "pieces")
        parts, bridges = _owned(pieces.where("open"), overlap)
        out = pieces.where("not open").select("title", "seq", "offset").unionByName(parts).unionByName(bridges)
    return out.select("title", F.substring_index("title", " ", 1).alias("ref"), "seq", "offset")


def _owned(edges: DataFrame, overlap: int) -> tuple[DataFrame, DataFrame]:
    """The open pieces as chunks (title, seq, offset in the record), and the bridges between those of a record where splits meet: up to `overlap` letters of the
    first and as many after it, so that the windows that begin in the one and end in another are in a bridge once. There are two parts or so a split."""
    left = lambda c: F.substr(c, F.lit(1), F.lit(overlap))
    right = lambda c: F.when(F.length(c) > overlap, F.substr(c, F.length(c) - overlap + 1)).otherwise(c)
    seq, here = F.col("seq"), ["file", "block", "record"]
    part = edges.groupBy(*here).agg(F.max("title").alias("title"), F.max(F.col("offset") + F.length(seq)).alias("n"), F.min_by(left(seq), "offset").alias("head"), F.max_by(right(seq), "offset").alias("tail"))
    begun = F.col("title").isNotNull()
    upto = Window.partitionBy("file").orderBy("block", "record").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(begun, F.struct("block", "record")), ignorenulls=True).over(upto)
    part = part.withColumn("owner", owner).withColumn("titled", F.max(begun).over(Window.partitionBy("file")))
    nothing = F.raise_error(F.concat(F.lit("no title line in the FASTA file "), F.col("file"))).cast("boolean")
    part = part.where(F.when(~F.col("titled"), nothing).otherwise(True)).where("owner is not null")
    record = Window.partitionBy("file", "owner").orderBy("block", "record")
    before = F.sum("n").over(record.rowsBetween(Window.unboundedPreceding, -1))
    after = F.array_join(F.collect_list("head").over(record.rowsBetween(1, Window.unboundedFollowing)), "")
    part = part.select(*here, F.first("title").over(record).alias("title"), F.coalesce(before, F.lit(0)).alias("base"), "n", "tail", left(after).alias("next"))
    chunks = edges.drop("title").join(part.select(*here, "title", "base"), here).select("title", "seq", (F.col("base") + F.col("offset")).alias("offset"))
    bridges = part.where("next <> ''").select("title", F.concat("tail", "next").alias("seq"), (F.col("base") + F.col("n") - F.length("tail")).alias("offset"))
    return chunks, bridges


def _fresh(spark: SparkSession, path: str, mode: str) -> None:
    if mode != "overwrite" and exists(spark, path):
        raise FileExistsError(f"not empty: {path}")


def write_parts(df: DataFrame, path: str, layout: str = "fasta", compression: str = "none", mode: str = "append", batch_size: int = 0) -> None:
    """Write in the order of df's partitions, files being named in that order: (header, seq) rows as FASTA, nulls as empty, or (layout tsv) any columns as lines.
    batch_size: records of a file at most. A folder that holds data is an error, unless mode is overwrite."""
    _fresh(df.sparkSession, path, mode)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    value = F.concat(F.lit(">"), text("header"), F.lit("\n"), text("seq")) if layout == "fasta" else F.concat_ws("\t", *map(text, df.columns))
    df.select(value.alias("value")).write.mode(mode).option("compression", compression).option("maxRecordsPerFile", batch_size).text(path)


def append_parts(df: DataFrame, path: str, compression: str = "none", batch_size: int = 0) -> None:
    """Add (header, seq) rows to a folder of FASTA batches as further files."""
    df.select(F.concat(F.lit(">"), "header", F.lit("\n"), "seq").alias("value")).write.mode("append").option("compression", compression).option("maxRecordsPerFile", batch_size).text(path)


def write_vectors(vector: DataFrame, path: str, k: int, mode: str = "append", replace: bool = False) -> None:
    """Sparse or dense vectors, a gzip file for each (ref, strand), named `ref___strand.gz`; the first line is `# k=K`, then comes one count per line from position 0.
    Zeros between positions are filled in while writing, in blocks of bounded size. '/' in a ref is written as %2F. Cells that are filled twice are as for reduce.cells."""
    from strandmill.operators.reduce import cells

    _fresh(vector.sparkSession, path, mode)
    file = F.concat(_escaped("ref"), F.lit("___"), "strand", F.lit(".gz"))
    # The file of a vector is one task's, as its lines are in order.
    w = Window.partitionBy("file").orderBy("pos")
    rows = cells(vector, replace).select(file.alias("file"), "pos", "count").where("file is not null")
    rows = rows.select("file", "count", "pos", F.lag("pos").over(w).alias("before"))
    rows = rows.withColumn("gap", F.col("pos") - F.coalesce("before", F.lit(-1)) - 1)
    rows = rows.select("file", "count", "before", "gap", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"gap div {ZEROS}"))).alias("b"))
    last = F.col("b") == F.expr(f"gap div {ZEROS}")
    zeros = F.expr(f"repeat('0\\n', cast(CASE WHEN b = gap div {ZEROS} THEN gap % {ZEROS} ELSE {ZEROS} - 1 END AS int))")
    head = F.when(F.col("before").isNull() & (F.col("b") == 0), f"# k={k}\n").otherwise("")
    _write_files(rows.select("file", F.concat(head, zeros, F.when(last, F.col("count").cast("string")).otherwise("0")).alias("value")), path, mode)


def write_cells(cells: DataFrame, path: str, k: int, strands: tuple[str, ...], mode: str = "append") -> None:
    """The same files from the cells of packs.cells, whose counts hold for each of the strands."""
    _fresh(cells.sparkSession, path, mode)
    rows = cells.select(_escaped("ref").alias("ref"), "block", "counts").repartition(width(cells.sparkSession), "ref").sortWithinPartitions("ref", "block")
    lines = rows.mapInArrow(_texts(k, strands), "file string, at bigint, value string")
    _write_files(lines.sortWithinPartitions("file", "at").select("file", "value"), path, mode)


def _escaped(ref: str) -> Column:
    return F.replace(F.replace(ref, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))


def _texts(k: int, strands: tuple[str, ...]):
    """(ref, block, counts) in order -> (file, at, value): lines of the files, numbered, each value at most a block of them."""
    from strandmill.operators.packs import BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref, at, end = None, 0, 0
        for b in batches:
            lists, out, made = b.column(2), [], 0
            ends, values = lists.offsets.to_pylist(), lists.values
            for i, (name, block) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                texts = []
                if name != ref:
                    ref, at, end = name, 0, 0
                    texts.append(f"# k={k}")
                while end < block * BLOCK:
                    n = min(block * BLOCK - end, BLOCK)
                    texts.append("\n".join(["0"] * n))
                    end += n
                texts.append("\n".join(map(str, values[ends[i] : ends[i + 1]].to_pylist())))
                end += ends[i + 1] - ends[i]
                for text in texts:
                    out.extend((f"{ref}___{strand}.gz", at, text) for strand in strands)
                    at += 1
                    made += len(text) * len(strands)
                    if made > 1 << 24:
                        yield _lines(out)
                        out, made = [], 0
            if out:
                yield _lines(out)

    return run


def _lines(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], names=["file", "at", "value"])


def local(spark: SparkSession, path: str) -> str | None:
    """The path as the operating system knows it, where it is in a file system of the machines themselves."""
    fs, p = file_system(spark, path)
    return p.toUri().getPath() if fs.getUri().getScheme() == "file" else None


def _put(folder: str):
    """(file, value), the rows of a file one after another -> gzip files in a folder, and how many. A file gets its name when it is whole, so attempts at a task may repeat or overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f, made = None, None, 0

        def settle() -> None:
            nonlocal made
            if f is not None:
                f.close()
                os.replace(draft, f"{folder}/{name}")
                made += 1

        for b in batches:
            for file, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if file != name:
                    settle()
                    name, draft = file, f"{folder}/.{uuid.uuid4().hex}"
                    f = gzip.open(draft, "wb", 6)
                f.write(value.encode() + b"\n")
        settle()
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64())], names=["n"])

    return run


def _write_files(lines: DataFrame, path: str, mode: str) -> None:
    """Rows (file, value), those of a file in one partition, one after another and in order, as gzip files that are named so."""
    spark = lines.sparkSession
    fs, root = file_system(spark, path)
    name = f"_{uuid.uuid4().hex}"
    if folder := local(spark, path):
        # The work of Spark's writer and its commit, and of a rename by way of Hadoop, is many times that of a small file itself.
        os.makedirs(f"{folder}/{name}")
        lines.mapInArrow(_put(f"{folder}/{name}"), "n bigint").agg(F.sum("n")).collect()
        for file in os.listdir(f"{folder}/{name}"):
            if file[0] == "." and len(file) == 33:
                os.remove(f"{folder}/{name}/{file}")  # left by an attempt that failed
                continue
            if mode == "overwrite" and os.path.exists(f"{folder}/.{file}.crc"):
                os.remove(f"{folder}/.{file}.crc")
            os.replace(f"{folder}/{name}/{file}", f"{folder}/{file}")
        os.rmdir(f"{folder}/{name}")
    else:
        _place(lines, path, name, mode)
    fs.create(spark._jvm.org.apache.hadoop.fs.Path(root, "_SUCCESS"), True).close()


def _place(lines: DataFrame, path: str, name: str, mode: str) -> None:
    """By Spark's writer, for any file system: a folder for each file, whose one part is renamed after the job."""
    spark, draft = lines.sparkSession, f"{path}/{name}"
    lines.write.partitionBy("file").option("compression", "gzip").text(draft)
    fs, root = file_system(spark, path)
    jvm = spark._jvm
    unescape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    Path = jvm.org.apache.hadoop.fs.Path

    def place(folder: str) -> None:
        target = Path(root, Path(None, None, unescape(folder.removeprefix("file="))))
        if mode == "overwrite":
            fs.delete(target, False)
        for part in fs.listStatus(Path(f"{draft}/{folder}")):  # one
            fs.rename(part.getPath(), target)

    names = [n for n in (s.getPath().getName() for s in fs.listStatus(Path(draft))) if n.startswith("file=")]
    with ThreadPoolExecutor(16) as pool:  # the work of each is a call or two to the file system
        list(pool.map(place, names))
    fs.delete(Path(draft), True)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of a folder of vector files. A gzip file is one task's and its lines come in order, so they are numbered as they come."""
    kinds, folder = "file string, line_no bigint, line string", local(spark, path)
    if folder:
        files = [(f.name, f.stat().st_size) for f in os.scandir(folder) if f.name[0] not in "._"]
        tasks = max(4 * width(spark), sum(size for _, size in files) >> 22, len(files) // 2000)
        names = spark.createDataFrame(pa.table({"file": pa.array([name for name, _ in files], pa.string())}))
        return names.repartition(tasks).mapInArrow(_opened(folder), kinds)
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    lines = spark.read.text(path).select(name.alias("file"), F.col("value").alias("line"))
    # Spark puts but a few small files into one split.
    return lines.coalesce(max(4 * width(spark), lines.rdd.getNumPartitions() // 32)).mapInArrow(_numbered, kinds)


def _opened(folder: str):
    """Names of gzip files -> (file, line_no, line), read in pieces of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, firsts, counts, size = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            text = np.frombuffer(b"".join(held), np.uint8)
            ends = np.flatnonzero(text == 10)
            offsets = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int32)  # without the line feeds
            lines = pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets.tobytes()), pa.py_buffer(text[text != 10].tobytes()))
            line_no = np.arange(len(ends)) - np.repeat(np.cumsum([0, *counts])[:-1] - np.array(firsts), counts)
            files = pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(len(names)), counts)))
            for x in (held, names, firsts, counts):
                x.clear()
            size = 0
            return pa.RecordBatch.from_arrays([files, pa.array(line_no, pa.int64()), lines], names=["file", "line_no", "line"])

        for b in batches:
            for name in b.column(0).to_pylist():
                first, rest = 0, b""
                with gzip.open(f"{folder}/{name}") as f:
                    while piece := f.read(1 << 20) or rest and b"\n":
                        whole, found, rest = (rest + piece).rpartition(b"\n")
                        if found:
                            n = whole.count(b"\n") + 1
                            for x, y in ((held, whole + b"\n"), (names, name), (firsts, first), (counts, n)):
                                x.append(y)
                            first, size = first + n, size + len(whole)
                            if size > 1 << 20:
                                yield flush()
        if held:
            yield flush()

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, n = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        runs = pc.run_end_encode(b.column(0))
        ends, names = runs.run_ends.to_pylist(), runs.values.to_pylist()
        parts, begin = [], 0
        for end, file in zip(ends, names):
            if file != name:
                name, n = file, 0
            parts.append(np.arange(n, n + end - begin))
            n, begin = n + end - begin, end
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(parts), pa.int64()), b.column(1)], names=["file", "line_no", "line"])


def concatenate(spark: SparkSession, folder: str, out: str) -> None:
    """Join the parts of a folder, in order, into one file (gzip parts may be joined as they are)."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, p = file_system(spark, folder)
    to_fs, to = file_system(spark, out)
    stream = to_fs.create(to, True)
    try:
        for path in sorted((s.getPath() for s in fs.listStatus(p) if s.getPath().getName()[0] not in "._"), key=lambda x: x.getName()):
            part = fs.open(path)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, stream, conf, False)
            part.close()
    finally:
        stream.close()
