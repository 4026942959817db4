"""Exports: rows rendered to the lines of tabular, bibliographic and graph formats, and writers for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .payloads import xml_escape


def flatten(df: DataFrame, sep: str = "_", join: str = "; ") -> DataFrame:
    """Structs to columns named parent_child, arrays to joined text."""
    def columns(schema: T.StructType, prefix: list[str]) -> list[Column]:
        out = []
        for f in schema.fields:
            path = [*prefix, f.name]
            c = F.col(".".join(f"`{p}`" for p in path))
            if isinstance(f.dataType, T.StructType):
                out += columns(f.dataType, path)
            elif isinstance(f.dataType, T.ArrayType):
                out.append(F.array_join(c.cast("array<string>"), join).alias(sep.join(path)))
            else:
                out.append(c.alias(sep.join(path)))
        return out

    return df.select(*columns(df.schema, []))


def union_of_columns(parts: list[DataFrame]) -> DataFrame:
    """All rows under the sorted union of the parts' columns."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.select(*sorted(whole.columns))


def write_csv(df: DataFrame, path: str) -> None:
    flatten(df).write.mode("overwrite").option("header", True).csv(path)


def write_excel(df: DataFrame, path: str) -> str:
    """A spreadsheet at path, or CSV files there if no library for spreadsheets is installed; says which. A sheet holds
    at most 1,048,575 rows, so more are refused."""
    try:
        import openpyxl
    except ImportError:
        write_csv(df, path)
        return "csv"
    rows = flatten(df).limit(1_048_576).toPandas()
    if len(rows) > 1_048_575:
        raise ValueError("too many rows for a sheet")
    book = openpyxl.Workbook()
    for row in [list(rows.columns), *rows.itertuples(index=False)]:
        book.active.append(list(row))
    book.save(path)
    return "excel"


def profile_lines(profiles: DataFrame, by: str = "followers") -> DataFrame:
    """(ord, line): a comparison of (name, followers, following, posts), largest first, then by name."""
    shown = F.concat(F.lit("@"), "name", F.lit(": "), F.col(by).cast("string"), F.lit(" followers, "), F.col("following").cast("string"), F.lit(" following, "), F.col("posts").cast("string"), F.lit(" posts"))
    order = F.concat(F.lpad((F.lit(10**15) - F.col(by)).cast("string"), 16, "0"), F.lit(" "), "name")
    return profiles.select(order.alias("ord"), shown.alias("line"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_lines(lines: DataFrame, path: str, header: str = "", footer: str = "") -> None:
    """(ord, line) as text in order, with a header and footer; range-partitioned, so no single task holds all lines."""
    spark = lines.sparkSession
    ends = [(t, x) for t, x in ((0, header), (2, footer)) if x]
    rows = lines.select(F.lit(1).alias("t"), "ord", "line")
    if ends:
        rows = rows.unionByName(spark.createDataFrame([(t, "", x) for t, x in ends], "t int, ord string, line string"), allowMissingColumns=True) if dict(lines.dtypes)["ord"] == "string" else rows.unionByName(spark.createDataFrame([(t, 0, x) for t, x in ends], "t int, ord long, line string"))
    rows.repartitionByRange("t", "ord").sortWithinPartitions("t", "ord").select("line").write.mode("overwrite").text(path)


def _texts(papers: DataFrame, names: list[str]) -> dict[str, Column]:
    """The named columns as texts; a column that papers lacks, a null and year 0 are empty."""
    have = set(papers.columns)
    out = {n: F.coalesce(F.col(n).cast("string"), F.lit("")) if n in have else F.lit("") for n in names}
    if "year" in out:
        out["year"] = F.when(out["year"] == "0", "").otherwise(out["year"])
    return out


def _names(papers: DataFrame, column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>")) if column in papers.columns else F.array().cast("array<string>")


def _field(name: str, value: Column) -> Column:
    """A BibTeX line, null for an empty value."""
    return F.when(value != "", F.concat(F.lit(f"  {name} = {{"), value, F.lit("},")))


def bibtex(papers: DataFrame) -> DataFrame:
    """(paper_id, key, entry) of papers (paper_id, title, author_names and what there is of year, journal, volume, issue,
    pages, doi, url, abstract).

    Key: last word of the first author, year, first word of the title in lower case. Of papers with one key the first (by
    paper_id) keeps it, later ones get a, b, ... z, aa and so on (after zz the first letter goes on through the code points). Abstracts stop at 500 characters, as the format has it.
    """
    x = _texts(papers, ["title", "year", "journal", "volume", "issue", "pages", "doi", "url", "abstract"])
    authors = _names(papers, "author_names")
    year = F.coalesce(F.col("year").cast("string"), F.lit("0")) if "year" in papers.columns else F.lit("0")
    last = F.when(F.size(authors) > 0, F.element_at(F.split(F.trim(F.get(authors, F.lit(0))), r"\s+"), -1)).otherwise("unknown")
    word = F.when(x["title"] != "", F.lower(F.element_at(F.split(F.trim(x["title"]), r"\s+"), 1))).otherwise("untitled")
    abstract = F.substring(F.replace(F.replace(x["abstract"], F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}")), 1, 500)
    body = F.concat_ws(
        "\n", F.concat(F.lit("  title = {"), x["title"], F.lit("},")), _field("author", F.array_join(authors, " and ")), _field("year", x["year"]), _field("journal", x["journal"]), _field("volume", x["volume"]),
        _field("number", x["issue"]), _field("pages", x["pages"]), _field("doi", x["doi"]), _field("url", x["url"]), _field("abstract", abstract), F.lit("}"))
    rows = papers.select("paper_id", F.concat(last, year, word).alias("base"), body.alias("body"))
    n = F.row_number().over(Window.partitionBy("base").orderBy("paper_id")) - 1  # 0 for the one that keeps the key
    letter = F.char((F.lit(97) + F.pmod(F.col("n") - 1, F.lit(26))).cast("int"))
    # char() takes codes modulo 256, which would give keys twice
    code = F.lpad(F.hex(F.lit(96) + F.floor((F.col("n") - 1) / 26)), 8, "0")
    before = F.when(F.col("n") > 26, F.decode(F.unhex(code), "UTF-32")).otherwise("")
    key = F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat("base", before, letter))
    rows = rows.withColumn("n", n).select("paper_id", key.alias("key"), "body")
    return rows.select("paper_id", "key", F.concat(F.lit("@article{"), "key", F.lit(",\n"), "body").alias("entry"))


def ris(papers: DataFrame) -> DataFrame:
    """(paper_id, entry) with the tags that have a value; a page range is cut at its first dash, abstracts stop at 1000
    characters, as the format has it."""
    x = _texts(papers, ["title", "year", "journal", "volume", "issue", "pages", "doi", "url", "abstract"])

    def tag(name: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"{name}  - "), value))

    def tags(name: str, values: Column) -> Column:
        return F.when(F.size(values) > 0, F.array_join(F.transform(values, lambda v: F.concat(F.lit(f"{name}  - "), v)), "\n"))

    ranged = x["pages"].contains("-")
    first = F.when(ranged, F.trim(F.split_part(x["pages"], F.lit("-"), F.lit(1)))).otherwise(x["pages"])
    end = F.when(ranged, F.trim(F.regexp_replace(x["pages"], "^[^-]*-", ""))).otherwise("")
    entry = F.concat_ws(
        "\n", F.lit("TY  - JOUR"), F.concat(F.lit("TI  - "), x["title"]), tags("AU", _names(papers, "author_names")), tag("PY", x["year"]), tag("JO", x["journal"]), tag("VL", x["volume"]), tag("IS", x["issue"]),
        tag("SP", first), tag("EP", end), tag("DO", x["doi"]), tag("UR", x["url"]), tag("AB", F.substring(x["abstract"], 1, 1000)), tags("KW", _names(papers, "keywords")), F.lit("ER  - "))
    return papers.select("paper_id", entry.alias("entry"))


def paper_csv(papers: DataFrame) -> DataFrame:
    """Papers as text columns of a table: authors, topics and keywords joined by '; ', abstracts up to 500 characters."""
    x = _texts(papers, ["title", "journal", "doi", "citation_count", "abstract", "url", "is_open_access"])
    year = F.coalesce(F.col("year").cast("string"), F.lit("0")) if "year" in papers.columns else F.lit("0")
    joined = {n: F.array_join(_names(papers, c), "; ") for n, c in (("authors", "author_names"), ("topics", "topics"), ("keywords", "keywords"))}
    return papers.select(
        "paper_id", x["title"].alias("title"), joined["authors"].alias("authors"), year.alias("year"), x["journal"].alias("journal"), x["doi"].alias("doi"), x["citation_count"].alias("citation_count"),
        F.substring(x["abstract"], 1, 500).alias("abstract"), x["url"].alias("url"), x["is_open_access"].alias("is_open_access"), joined["topics"].alias("topics"), joined["keywords"].alias("keywords"))


def markdown_row(papers: DataFrame) -> DataFrame:
    """One table line per paper, bars escaped."""
    return papers.select("paper_id", F.concat(F.lit("| "), F.replace("title", F.lit("|"), F.lit("\\|")), F.lit(" | "), F.col("year").cast("string"), F.lit(" | "), F.col("citation_count").cast("string"), F.lit(" |")).alias("line"))


def markdown_review(papers: DataFrame) -> DataFrame:
    """(ord, line) of a review of papers (paper_id, title, author_names, year, journal, doi, citation_count, is_open_access,
    abstract): a summary, then papers by number of citations and id, with up to three authors and 300 characters of abstract."""
    total = papers.agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("year") > 0, F.col("year"))).alias("a"), F.max("year").alias("b"), F.sum("citation_count").alias("c"), F.count_if("is_open_access").alias("oa"))
    heads = ["# Literature review", F.concat(F.lit("- papers: "), F.col("n").cast("string")), F.concat(F.lit("- years: "), F.col("a").cast("string"), F.lit(" to "), F.col("b").cast("string")), F.concat(F.lit("- citations: "), F.col("c").cast("string")), F.concat(F.lit("- open access: "), F.col("oa").cast("string"))]
    summary = total.select(F.posexplode(F.array(*(h if isinstance(h, Column) else F.lit(h) for h in heads))).alias("p", "line")).select(F.concat(F.lit("0"), F.lpad(F.col("p").cast("string"), 2, "0")).alias("ord"), "line")
    names = F.array_join(F.slice("author_names", 1, 3), ", ")
    authors = F.when(F.size("author_names") > 3, F.concat(names, F.lit(" et al."))).otherwise(names)
    quote = F.when(F.coalesce("abstract", F.lit("")) != "", F.concat(F.lit("> "), F.substring("abstract", 1, 300), F.when(F.length("abstract") > 300, "...").otherwise("")))
    body = F.concat_ws("\n", F.concat(F.lit("## "), "title"), F.concat(F.lit("**"), authors, F.lit("** ("), F.col("year").cast("string"), F.lit(")")), F.concat(F.lit("*"), "journal", F.lit("*, citations: "), F.col("citation_count").cast("string")), F.when(F.coalesce("doi", F.lit("")) != "", F.concat(F.lit("DOI: "), "doi")), quote)
    order = F.concat(F.lit("1"), F.lpad((F.lit(10**15) - F.col("citation_count")).cast("string"), 16, "0"), F.lpad(F.col("paper_id").cast("string"), 20, "0"))
    return summary.unionByName(papers.select(order.alias("ord"), body.alias("line")))


def dispatch(rows: DataFrame, url: str, secret: str, key: str, body: str, tries: int = 3, timeout: float = 10.0) -> DataFrame:
    """Posts each row's JSON body to url and gives (key, delivered, status, attempts).

    Every request names its delivery (the hash of key and body, the same at every try and run, so that a receiver can drop
    repeats), and signs its body by HMAC-SHA256. Answers below 300 are deliveries; others and failures are tried again.
    """
    import hashlib
    import hmac
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    import pandas as pd

    def run(batches):
        for pdf in batches:
            out = []
            for k, text in zip(pdf[key], pdf[body], strict=True):
                raw = (text or "").encode()
                head = {"Content-Type": "application/json", "X-Delivery": hashlib.sha256(f"{k}:".encode() + raw).hexdigest(), "X-Signature": hmac.new(secret.encode(), raw, hashlib.sha256).hexdigest()}
                status = 0
                for n in range(1, tries + 1):
                    try:
                        with urlopen(Request(url, raw, head), timeout=timeout) as answer:
                            status = answer.status
                    except HTTPError as e:
                        status = e.code
                    except OSError:
                        status = 0
                    if 0 < status < 300:
                        break
                out.append((k, 0 < status < 300, status, n))
            yield pd.DataFrame(out, columns=[key, "delivered", "status", "attempts"])

    return rows.select(key, body).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, delivered boolean, status int, attempts int")


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, line): node elements before edge elements, ids escaped."""
    n = nodes.select(F.concat(F.lit("0"), F.col("node").cast("string")).alias("ord"), F.concat(F.lit('<node id="'), xml_escape(F.col("node").cast("string")), F.lit('"/>')).alias("line"))
    e = edges.select(F.concat(F.lit("1"), F.col("src").cast("string"), F.lit("/"), F.col("dst").cast("string")).alias("ord"), F.concat(F.lit('<edge source="'), xml_escape(F.col("src").cast("string")), F.lit('" target="'), xml_escape(F.col("dst").cast("string")), F.lit('"/>')).alias("line"))
    return n.unionByName(e)


GRAPHML = ('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">', "</graph></graphml>")


def gexf_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select(F.concat(F.lit("0"), F.col("node").cast("string")).alias("ord"), F.concat(F.lit('<node id="'), xml_escape(F.col("node").cast("string")), F.lit('" label="'), xml_escape(F.col("node").cast("string")), F.lit('"/>')).alias("line"))
    e = edges.select(F.concat(F.lit("1"), F.col("src").cast("string"), F.lit("/"), F.col("dst").cast("string")).alias("ord"), F.concat(F.lit('<edge source="'), xml_escape(F.col("src").cast("string")), F.lit('" target="'), xml_escape(F.col("dst").cast("string")), F.lit('"/>')).alias("line"))
    return n.unionByName(e)


def network_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON object per node and per link."""
    n = nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), F.col("node").alias("id"))).alias("line"))
    return n.unionByName(edges.select(F.to_json(F.struct(F.lit("link").alias("kind"), F.col("src").alias("source"), F.col("dst").alias("target"), "weight")).alias("line")))


def map_tsv(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat_ws("\t", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("weight").cast("string")).alias("line"))


def state_delta(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change, value): added, removed and changed entries between two states."""
    a, b = old.select(F.col(key).alias("k"), F.col(value).alias("a"), F.lit(True).alias("ina")), new.select(F.col(key).alias("k"), F.col(value).alias("b"), F.lit(True).alias("inb"))
    j = a.join(b, "k", "full_outer")
    change = F.when(F.col("ina").isNull(), "added").when(F.col("inb").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return j.select(F.col("k").alias(key), change.alias("change"), F.col("b").alias(value)).filter("change IS NOT NULL")


def latest(log: DataFrame, key: str, order: str, deleted: str) -> DataFrame:
    """The current rows of an append-only log: each key's last entry, unless it marks a deletion."""
    last = log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), order).alias("x"))
    return last.select(key, "x.*").filter(~F.col(deleted))
