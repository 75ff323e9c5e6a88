"""Registry listings, page texts and downloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from municipia import schemas
from municipia.functions import constants as K
from municipia.functions.text import one_line, strip


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """commune, page, place, acte: the entries of every page file, in order of file and place."""
    pages = spark.read.schema(schemas.LISTING).option("multiLine", True).json(path)
    return pages.select("commune", F.col("_metadata.file_path").alias("page"), F.posexplode("actes").alias("place", "acte"))


def last_segment(url: Column, back: int = 1) -> Column:
    """The last (or back-th last) part of a URL's path."""
    return F.try_element_at(F.split(F.regexp_replace(F.coalesce(url, F.lit("")), "/+$", ""), "/"), F.lit(-back))


def select_decrees(listing: DataFrame, start_year: int, number: str = K.DECREE_NUMBER) -> DataFrame:
    """schemas.ACTS of the decrees in read_listing(): numbered as such, published from start_year on; the id comes from the
    document's URL, or from number and date; of one id the last entry stays."""
    a = F.col("acte")
    raw = strip(F.coalesce(a["numero"], F.lit("")))
    published = F.substring(F.coalesce(F.nullif(a["datePublication"], F.lit("")), a["dateDecision"]), 1, 10)
    papers = F.concat(F.filter(F.array(a["documentPrincipal"]), lambda d: d.isNotNull()), F.coalesce(a["annexes"], F.array().cast(f"array<{schemas.DOCUMENT}>")))
    pdf = F.get(F.filter(papers, lambda d: d["mimeType"] == "application/pdf"), F.lit(0))
    slug = F.regexp_replace(F.regexp_replace(F.concat_ws("-", raw, published), "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", "")
    kept = listing.where(raw.rlike(number) & (F.substring(published, 1, 4).try_cast("int") >= start_year)).select(
        "commune", "page", "place",
        F.coalesce(F.nullif(last_segment(pdf["url"], 2), F.lit("")), slug).alias("id"),
        F.regexp_replace(raw, r"(?U)\s+", " ").alias("numero"),
        F.coalesce(a["objet"], F.lit("")).alias("objet"),
        F.try_to_date(F.substring(a["dateDecision"], 1, 10)).alias("date_decision"),
        F.try_to_date(published).alias("date_publication"),
        pdf["url"].alias("pdf_url"), pdf["filename"].alias("pdf_name"), pdf["size"].alias("pdf_taille"),
    )
    last = F.row_number().over(Window.partitionBy("commune", "id").orderBy(F.desc("page"), F.desc("place")))
    return kept.withColumn("last", last).where("last = 1").drop("last", "page", "place")


def fingerprint(numero: Column, objet: Column, decided: Column, pdf_url: Column, size: Column) -> Column:
    """Changes with the act or its document, not with the host that serves it."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat_ws("|", text(numero), one_line(text(objet)), text(decided), F.coalesce(last_segment(pdf_url), F.lit("")), text(size))


def document_texts(pages: DataFrame) -> DataFrame:
    """commune, act_id, text, method from pages (commune, act_id, page_no, native_text, ocr_text): up to the page limit, a
    page's own text if it is long enough, else the recognised one."""
    native = strip(F.coalesce("native_text", F.lit("")))
    own = F.length(native) >= K.NATIVE_PAGE_CHARS
    rank = F.row_number().over(Window.partitionBy("commune", "act_id").orderBy("page_no"))
    kept = pages.withColumn("rank", rank).where(F.col("rank") <= K.MAX_PAGES)
    chosen = kept.select("commune", "act_id", "rank", own.alias("own"), F.when(own, F.col("native_text")).otherwise(F.coalesce("ocr_text", F.lit(""))).alias("page"))
    found = chosen.groupBy("commune", "act_id").agg(F.sort_array(F.collect_list(F.struct("rank", "page"))).alias("ps"), F.bool_or("own").alias("any"), F.bool_and("own").alias("all"))
    text = F.array_join(F.transform("ps", lambda p: p["page"]), "\n\f\n")
    method = F.when(F.trim(F.regexp_replace(text, r"(?U)[\s\f]+", "")) == "", "vide").when(F.col("all"), "natif").when(F.col("any"), "mixte").otherwise("ocr")
    return found.select("commune", "act_id", text.alias("text"), method.alias("method"))


def read_pdf_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(files that are PDF, those that are not), path, length and content, from binary files."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    is_pdf = F.substring("content", 1, 4) == F.lit(b"%PDF")
    return files.where(is_pdf), files.where(~is_pdf)
