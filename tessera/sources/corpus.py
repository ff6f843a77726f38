"""An inventory of a corpus of papers: files with their hashes and copies, the records of RIS files, and what links the two."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

TAG = re.compile(r"^([A-Z][A-Z0-9])  - (.*)$")
FIELDS = "ris_index: int, paper_id: string, title: string, authors: array<string>, year: string, doi: string, url: string, links: array<struct<type: string, path: string>>, tags: map<string, array<string>>"
LINKS = ("L1", "L2", "L3", "L4")


def records_of(lines: Iterator[str], *, joined: bool = False) -> Iterator[dict[str, list[str]]]:
    """The records of a RIS file, tag to values in order; a record ends with ER, with the next TY, or with the file. Unknown tags are kept. Lines without a tag are passed over, or ``joined`` to the value before."""
    record: dict[str, list[str]] = {}
    last = None
    for line in lines:
        found = TAG.match(line)
        if not found:
            if joined and last and line.strip():
                record[last][-1] = f"{record[last][-1]} {line.strip()}".strip()
            continue
        tag, value = found.groups()
        if tag in ("TY", "ER") and record:
            yield record
            record = {}
        last = None if tag == "ER" else tag
        if last:
            record.setdefault(tag, []).append(value.strip())
    if record:
        yield record


def paper_id(record: dict[str, list[str]]) -> str:
    """By the DOI, else the title, else the whole record."""
    basis = next((record[t][0] for t in ("DO", "TI") if record.get(t) and record[t][0]), None) or json.dumps(record)
    return "paper-" + hashlib.sha256(basis.casefold().strip().encode()).hexdigest()[:16]


@udtf(returnType=FIELDS)
class RisRecords:
    """The records of one file's text; a state machine over its lines, which makes a row where a record ends."""

    def eval(self, text: str, joined: bool) -> Iterator[tuple]:
        for i, r in enumerate(records_of(iter((text or "").removeprefix("﻿").splitlines()), joined=joined), 1):
            first = lambda tag: r[tag][0] if tag in r else None  # noqa: E731, B023
            links = [(t, x.replace("\\", "/")) for t in LINKS for x in r.get(t, [])]
            yield i, paper_id(r), first("TI"), r.get("AU", []), first("PY"), first("DO"), first("UR"), links, r


def ris_records(files: DataFrame, *, path: str = "path", text: str = "text", joined: bool = False) -> DataFrame:
    """path and the record's columns, for rows of a path and a whole file's text."""
    spark = files.sparkSession
    spark.udtf.register("ris_records", RisRecords)
    files.select(F.col(path).alias("ris_file"), F.col(text).alias("_text")).createOrReplaceTempView("_ris_files")
    return spark.sql(f"select f.ris_file, r.* from _ris_files f, lateral ris_records(f._text, {str(joined).lower()}) r")


def scan_corpus(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(files, records) of a folder. Files: relative_path, type, sha256, size_bytes, copies (paths of equal files, if there are several), paper_id, ris_link_type. Records: those of the RIS files, with linked_files and missing_links.

    A paper without a link from a record is named by its file's stem."""
    held = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    prefix = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"
    plain = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    relative = F.substring(plain(F.col("path")), F.length(plain(F.lit(prefix))) + 1, 1 << 30)
    kind = F.lower(F.regexp_extract(relative, r"\.([^./]+)$", 1))
    files = held.select(relative.alias("relative_path"), F.when(kind == "", "unknown").otherwise(kind).alias("type"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), F.when(kind == "ris", F.decode("content", "UTF-8")).alias("text"))
    records = ris_records(files.where("type = 'ris'").select("relative_path", "text"), path="relative_path")
    paths = files.select("relative_path")
    links = records.select("ris_file", "ris_index", "paper_id", F.posexplode("links").alias("n", "link")).select("*", "link.*").drop("link")
    known = links.join(paths.withColumnRenamed("relative_path", "path").withColumn("there", F.lit(True)), "path", "left")
    of_record = known.groupBy("ris_file", "ris_index").agg(*[F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("n", F.when(c, F.col("path")).alias("p")))), lambda x: x["p"])).alias(name) for c, name in ((F.col("there"), "linked_files"), (F.col("there").isNull(), "missing_links"))])
    none = F.array().cast("array<string>")
    records = records.join(of_record, ["ris_file", "ris_index"], "left").withColumns({c: F.coalesce(c, none) for c in ("linked_files", "missing_links")})
    # of several links to a file the last one counts
    of_file = known.where("there").groupBy("path").agg(F.max_by(F.struct("paper_id", "type"), F.struct("ris_file", "ris_index", "n")).alias("x")).select(F.col("path").alias("relative_path"), "x.paper_id", F.col("x.type").alias("ris_link_type"))
    copies = files.groupBy("sha256").agg(F.array_sort(F.collect_list("relative_path")).alias("copies")).where(F.size("copies") > 1)
    stem = F.lower(F.regexp_replace(F.element_at(F.split("relative_path", "/"), -1), r"(?<=.)\.[^.]*$", ""))
    unlinked = F.when(F.col("type").isin("pdf", "html", "htm"), F.concat(F.lit("paper-unlinked-"), F.substring(F.sha2(stem, 256), 1, 12)))
    files = files.drop("text").join(copies, "sha256", "left").join(of_file, "relative_path", "left").withColumn("paper_id", F.coalesce("paper_id", unlinked))
    return files.select("relative_path", "type", "sha256", "size_bytes", "copies", "paper_id", "ris_link_type"), records
