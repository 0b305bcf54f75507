"""Filing metadata: selection, identifiers, links, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.ids import pad_cik

ARCHIVE_URL = "https://www.sec.gov/Archives/edgar/data/%s/%s/%s"


def select_filings(submissions: DataFrame, form: str, limit: int) -> DataFrame:
    """The first ``limit`` filings of a form per company.

    ``submissions``: company keys and the parallel arrays form, accession_number,
    filing_date, report_date, primary_document.  Rows past the end of a shorter
    array are malformed and skipped.
    """
    arrays = ("form", "accession_number", "filing_date", "report_date", "primary_document")
    keys = [c for c in submissions.columns if c not in arrays]
    rows = submissions.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "f")).select(*keys, "pos", "f.*")
    shortest = F.least(*[F.size(a) for a in arrays])
    bounded = submissions.select(*keys, shortest.alias("have"))
    ok = rows.join(bounded, keys).where((F.col("pos") < F.col("have")) & (F.col("form") == form))
    w = Window.partitionBy(*keys).orderBy("pos")
    return ok.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).drop("pos", "have")


def latest(filings: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each key in ``order``."""
    w = Window.partitionBy(key).orderBy(*order)
    return filings.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)


def filing_url(cik: Column, accession: Column, document: Column) -> Column:
    bare = F.regexp_replace(pad_cik(cik), "^0+", "")
    return F.format_string(ARCHIVE_URL, F.when(bare == "", "0").otherwise(bare), F.replace(accession, F.lit("-"), F.lit("")), document)


def document_id(ticker: Column, accession: Column) -> Column:
    return F.concat_ws("_", ticker, F.replace(accession, F.lit("-"), F.lit("")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with the rows of ``new``: new values win, except ``keep_old``, which stay from the first download."""
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*rest).alias("o"))
    n = new.select(*keys, F.struct(*rest).alias("n"))
    m = o.join(n, keys, "full_outer")
    pick = [F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) if c in keep_old else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest]
    return m.select(*keys, *pick)
