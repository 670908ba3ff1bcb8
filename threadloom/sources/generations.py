"""Whole generations of a table as a data source: ``generations``.

    df.write.format("generations").option("path", root).option("device", "laptop").mode("append").save()
    spark.read.format("generations").option("path", root).load()

A write makes a new generation of its device: tasks write Parquet parts under names of their own; the commit writes the
manifest (parts with row counts and digests, schema), and last the pointer, which names the generation. Until then a
reader sees the generation before; a write that fails leaves nothing that is named. Parts of lost or repeated task
attempts are in no manifest and go with the commit. ``keep`` (2) generations stay behind the pointer.

A read gives, for every device (or the one asked for), the rows of the generation its pointer names, with ``_device``
and ``_generation``; each part is compared with its digest. A pointer or manifest that is damaged, or a part that is
missing or altered, refuses the device's rows: with ``onDamage`` = ``skip`` its rows are left out, else the read fails.
What can be seen while planning (pointer, manifest, missing or shortened parts) leaves out the whole device.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructType

from threadloom.sources import files

POINTER = "CURRENT"
MANIFEST = "manifest.json"
KEEP = 2


class Damaged(ValueError):
    """A generation is not what its manifest says."""


@dataclass
class Part(WriterCommitMessage):
    file: str
    n_rows: int
    size: int
    sha256: str


@dataclass(frozen=True)
class Slice(InputPartition):
    device: str
    generation: str
    address: str
    sha256: str


class _Hashed:
    """A sink that knows the digest and the size of what went through."""

    def __init__(self, out):
        self.out, self.hash, self.size, self.closed = out, hashlib.sha256(), 0, False

    def write(self, data) -> int:
        self.hash.update(data)
        self.size += len(data)
        return self.out.write(data)

    def flush(self) -> None:
        self.out.flush()

    def close(self) -> None:
        self.closed = True


class GenerationWriter(DataSourceArrowWriter):
    def __init__(self, options, schema: StructType):
        self.root = f"{options['path'].rstrip('/')}/{options.get('device', 'default')}"
        self.keep = int(options.get("keep", KEEP))
        self.schema = schema.json()
        # Names sort by time; the random part tells apart writes of the same moment.
        self.generation = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def write(self, iterator):
        import pyarrow.parquet as pq

        name = f"part-{uuid.uuid4().hex}.parquet"
        system, path = files.store(f"{self.root}/{self.generation}/{name}")
        system.create_dir(path.rpartition("/")[0], recursive=True)
        n, writer = 0, None
        with system.open_output_stream(path) as raw:
            out = _Hashed(raw)
            for batch in iterator:
                writer = writer or pq.ParquetWriter(out, batch.schema)
                writer.write_batch(batch)
                n += batch.num_rows
            if writer:
                writer.close()
        return Part(name if writer else "", n, out.size, out.hash.hexdigest())

    def commit(self, messages) -> None:
        parts = sorted((m for m in messages if m is not None and m.file), key=lambda m: m.file)
        told = {"generation": self.generation, "schema": self.schema, "n_rows": sum(p.n_rows for p in parts), "parts": [vars(p) for p in parts]}
        raw = json.dumps(told, sort_keys=True).encode()
        files.publish(f"{self.root}/{self.generation}/{MANIFEST}", raw)
        named = {p.file for p in parts} | {MANIFEST}
        for f in files.below(f"{self.root}/{self.generation}"):
            if (name := f.path.rpartition("/")[2]) not in named:
                files.remove(f"{self.root}/{self.generation}/{name}")
        files.publish(f"{self.root}/{POINTER}", json.dumps({"generation": self.generation, "sha256": hashlib.sha256(raw).hexdigest()}).encode())
        old = sorted(g for g in generations_of(self.root) if g < self.generation)
        for generation in old[: max(0, len(old) - self.keep)]:
            files.remove(f"{self.root}/{generation}")

    def abort(self, messages) -> None:
        files.remove(f"{self.root}/{self.generation}")


def generations_of(device: str) -> set[str]:
    """Generations of a device's folder that have a manifest."""
    _, base = files.store(device)
    inside = (f.path.removeprefix(base.rstrip("/") + "/").split("/") for f in files.below(device))
    return {p[0] for p in inside if len(p) == 2 and p[1] == MANIFEST}


def named_generation(device: str) -> dict | None:
    """The manifest that a device's pointer names; None without a pointer, ``Damaged`` if they do not fit."""
    pointer = files.read(f"{device}/{POINTER}")
    if pointer is None:
        return None
    try:
        at = json.loads(pointer)
        raw = files.read(f"{device}/{at['generation']}/{MANIFEST}")
        if raw is None or hashlib.sha256(raw).hexdigest() != at["sha256"]:
            raise Damaged(f"{device}: the manifest of {at['generation']} is missing or altered")
        told = json.loads(raw)
    except (ValueError, KeyError, TypeError) as e:
        raise Damaged(f"{device}: {e}") from e
    system, path = files.store(f"{device}/{told['generation']}")
    sizes = {f.path: f.size for f in system.get_file_info([f"{path}/{p['file']}" for p in told["parts"]])} if told["parts"] else {}
    for p in told["parts"]:
        if sizes[f"{path}/{p['file']}"] != p["size"]:
            raise Damaged(f"{device}: {p['file']} is missing or shortened")
    return told


def devices_of(root: str) -> list[str]:
    system, path = files.store(root)
    from pyarrow import fs

    return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.type == fs.FileType.Directory)


class GenerationReader(DataSourceReader):
    def __init__(self, source: GenerationSource, schema: StructType):
        self.root, self.skip, self.wanted, self.schema = source.root, source.skip, source.device, schema

    def partitions(self):
        out = []
        for device in [self.wanted] if self.wanted else devices_of(self.root):
            try:
                told = named_generation(f"{self.root}/{device}")
            except Damaged:
                if not self.skip:
                    raise
                continue
            for p in told["parts"] if told else ():
                out.append(Slice(device, told["generation"], f"{self.root}/{device}/{told['generation']}/{p['file']}", p["sha256"]))
        return out or [InputPartition(None)]

    def read(self, partition):
        import pyarrow as pa
        import pyarrow.parquet as pq

        if not isinstance(partition, Slice):
            return
        system, path = files.store(partition.address)
        digest = hashlib.sha256()
        with system.open_input_stream(path) as source:  # in pieces: a part is never held whole
            while data := source.read(1 << 20):
                digest.update(data)
        if digest.hexdigest() != partition.sha256:
            if self.skip:
                return
            raise Damaged(f"{partition.address} is altered")
        names = [f.name for f in self.schema.fields]
        with system.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches():
                own = {"_device": pa.array([partition.device] * batch.num_rows, pa.string()), "_generation": pa.array([partition.generation] * batch.num_rows, pa.string())}
                yield pa.RecordBatch.from_arrays([own[n] if n in own else batch.column(n) for n in names], names)


class GenerationSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "generations"

    def __init__(self, options):
        super().__init__(options)
        self.root, self.device, self.skip = options["path"].rstrip("/"), options.get("device"), options.get("onDamage") == "skip"

    def schema(self) -> StructType:
        """That of the first device with a sound generation, and the two columns that say where a row is from."""
        for device in [self.device] if self.device else devices_of(self.root):
            try:
                told = named_generation(f"{self.root}/{device}")
            except Damaged:
                continue
            if told:
                return StructType.fromJson(json.loads(told["schema"])).add("_device", StringType()).add("_generation", StringType())
        raise Damaged(f"{self.root} holds no sound generation to take the schema of; name one with schema()")

    def reader(self, schema):
        return GenerationReader(self, schema)

    def writer(self, schema, overwrite):
        return GenerationWriter(self.options, schema)
