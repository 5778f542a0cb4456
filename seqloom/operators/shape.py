"""Tables brought into the shapes that deliverables and later steps expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import accession_key, cell, first_number, letters, listed, sequence_key, signed, stripped
from ..sources.delimited import numbered
from .rules import confidence, first_match

#: The columns of a node table and of the substring deliverable.
NODE_COLUMNS = ("identifier", "enzyme_name", "pazy_id", "accession", "organism", "aa_sequence")
SUBSTRING_COLUMNS = ("group", "identifier", "enzyme_name", "length_aa", "role", "delta_aa", "position", "change", "aa_sequence", "comments", "most-wildtype")


def node_shape(df: DataFrame, number: str, label: str, prefix: str, names: dict[str, str], order: str) -> DataFrame:
    """Clusters, union rows or FASTA records in the six columns of a node table.

    ``identifier`` is the prefix, the row's number with at least four digits
    and its label.  A ``number`` that is not digits only is replaced by the
    row's place by ``order``.  ``names`` maps node columns to those of ``df``;
    others are blank.
    """
    placed = numbered(df, order)
    digits = stripped(number)
    value = F.when(digits.rlike(r"^\d+$"), digits.cast("long")).otherwise(F.col("_ord") + 1).cast("string")
    identifier = F.concat(F.lit(prefix), F.lpad(value, F.greatest(F.length(value), F.lit(4)), F.lit("0")), F.lit("|"), stripped(label))
    cells = {c: stripped(names[c]) if c in names else F.lit("") for c in NODE_COLUMNS[1:]}
    cells["aa_sequence"] = F.regexp_replace(cells["aa_sequence"], r"\s", "")
    return placed.select(identifier.alias("identifier"), *(cells[c].alias(c) for c in NODE_COLUMNS[1:]))


def separate_nodes(df: DataFrame, sequence: str, order: str, prefix: str = "v") -> DataFrame:
    """Every row with a sequence as a node of its own, duplicates too, numbered by ``order``: node_id, sequence_md5, sequence_length and the row."""
    placed = numbered(df.where(letters(sequence) != ""), order)
    number = (F.col("_ord") + 1).cast("string")
    node = F.concat(F.lit(prefix), F.lpad(number, F.greatest(F.length(number), F.lit(3)), F.lit("0")))
    return placed.withColumns({"node_id": node, "sequence_md5": sequence_key(sequence), "sequence_length": F.length(letters(sequence)).cast("long")}).drop("_ord")


def substring_shape(scan: DataFrame) -> DataFrame:
    """The substring scan as an 11-column deliverable; what curators fill in is blank."""
    cells = {"delta_aa": signed("delta_aa"), "change": F.lit(""), "comments": F.lit(""), "most-wildtype": F.lit("")}
    return scan.select(*(cells.get(c, F.col(f"`{c}`")).alias(c) for c in SUBSTRING_COLUMNS))


def component_rollup(members: DataFrame, component: str, label: Column, order: list[str], overlay: str, fold: str, cited: list[str]) -> DataFrame:
    """One row for each component: n, n_with_overlay, overlay labels by number, folds, citations and member labels in order.

    Citation columns are ';' lists; their parts are sorted within each column
    and the columns follow each other.
    """
    filled = lambda c: F.nullif(cell(c), F.lit(""))
    held = members.withColumn("_at", F.struct(*order)).withColumn("_label", label)
    cites = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(listed(c))))).alias(f"_{i}") for i, c in enumerate(cited)]
    found = held.groupBy(component).agg(
        F.count("*").alias("n"),
        F.count(filled(overlay)).alias("n_with_overlay"),
        F.array_sort(F.collect_set(F.struct(first_number(overlay, 10**9).alias("k"), filled(overlay).alias("v")))).alias("_overlay"),
        F.array_sort(F.collect_set(filled(fold))).alias("_folds"),
        F.array_sort(F.collect_list(F.struct(F.col("_at").alias("k"), F.col("_label").alias("v")))).alias("_members"),
        *cites,
    )
    text = lambda c: F.concat_ws(";", F.transform(F.filter(c, lambda x: x["v"].isNotNull()), lambda x: x["v"]))
    return found.select(component, "n", "n_with_overlay", text("_overlay").alias("overlays"), F.concat_ws(";", "_folds").alias("folds"), F.concat_ws(";", F.concat(*(F.col(f"_{i}") for i in range(len(cited))))).alias("citations"), text("_members").alias("members"))


def assigned(rows: DataFrame, clusters: DataFrame, sequence: str, md5: str, cluster: str) -> DataFrame:
    """Every row with its cluster, joined by the md5 of its letters, and assigned, unassigned or no_sequence."""
    keyed = rows.withColumn("_md5", sequence_key(sequence))
    joined = keyed.join(clusters.select(F.col(md5).alias("_md5"), F.col(cluster).alias(cluster)), "_md5", "left")
    status = first_match([("no_sequence", F.col("_md5") == ""), ("assigned", F.col(cluster).isNotNull())], "unassigned")
    return joined.withColumn("status", status).drop("_md5")


def borrowed_overlay(rows: DataFrame, union: DataFrame, order: str, sequence: str, accession: str, *values: str) -> DataFrame:
    """(sequence_md5, values): each key's first row; a row without a sequence takes the key of the union row with its accession."""
    lend = union.where(letters(sequence) != "").select(accession_key(accession).alias("_acc"), sequence_key(sequence).alias("_lent"), order).where("_acc <> ''")
    lend = lend.groupBy("_acc").agg(F.min_by("_lent", order).alias("_lent"))
    keyed = rows.withColumn("_acc", accession_key(accession)).join(lend, "_acc", "left")
    keyed = keyed.withColumn("sequence_md5", F.when(letters(sequence) != "", sequence_key(sequence)).otherwise(F.col("_lent"))).where("sequence_md5 is not null")
    return keyed.groupBy("sequence_md5").agg(*(F.min_by(v, order).alias(v) for v in values))


def citation_overlay(nodes: DataFrame, papers: DataFrame, node: str, ids: Column, accession: str, order: str) -> DataFrame:
    """(node, dois): the papers of all its ids, in order and each once; those of its accession only if no id has one.

    ``papers``: id, accession, doi; of several rows with a key the first by ``order`` counts.
    """
    known = papers.where(stripped("doi") != "")
    by_id = known.where(stripped("id") != "").groupBy(stripped("id").alias("_id")).agg(F.min_by(stripped("doi"), order).alias("_doi"))
    by_acc = known.where(accession_key("accession") != "").groupBy(accession_key("accession").alias("_acc")).agg(F.min_by(stripped("doi"), order).alias("_acc_doi"))
    found = nodes.select(node, F.posexplode(ids).alias("_pos", "_id")).join(by_id, "_id")
    found = found.groupBy(node).agg(F.array_sort(F.collect_list(F.struct("_pos", "_doi"))).alias("_found"))
    joined = nodes.select(node, accession_key(accession).alias("_acc")).join(found, node, "left").join(by_acc, "_acc", "left")
    dois = F.when(F.col("_found").isNotNull(), F.array_distinct(F.transform("_found", lambda x: x["_doi"]))).when(F.col("_acc_doi").isNotNull(), F.array("_acc_doi")).otherwise(F.array().cast("array<string>"))
    return joined.select(node, dois.alias("dois"))


def remapped(run: DataFrame, roster: DataFrame, node: str, md5: str = "sequence_md5") -> DataFrame:
    """A run's rows under the md5 of their nodes' sequences: node ids mean nothing in another run."""
    return run.join(roster.select(node, md5), node).drop(node)


def merged(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """``base`` and the rows of ``delta`` whose keys it does not have."""
    return base.unionByName(delta.join(base.select(key), key, "left_anti").select(base.columns))


def resolution(kind: Column, protein: Column, nucleotide: Column) -> Column:
    """How an accession resolved: resolves, is_protein, is_current, passed, note.

    ``protein`` is the record found (struct status, replaced_by, moltype,
    biomol; null: none) and ``nucleotide`` that of a nucleotide database
    (struct moltype, biomol).
    """
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    found, other = protein.isNotNull(), protein.isNull() & nucleotide.isNotNull()
    is_protein = found & ((F.lower(clean(protein["moltype"])) == "aa") | (F.lower(clean(protein["biomol"])) == "peptide"))
    status = clean(protein["status"])
    is_current = other | found & status.isin("", "live") & (clean(protein["replaced_by"]) == "")
    unknown = lambda c: F.coalesce(c, F.lit("?"))
    molecule = F.concat(F.lit("nucleotide record ("), unknown(nucleotide["moltype"]), F.lit("/"), unknown(nucleotide["biomol"]), F.lit("), not a protein"))
    # fixed values: the notes
    note = (
        F.when(other, molecule)
        .when(~found & (kind == "mgnify"), "MGnify identifier; not an NCBI record (resolve via MGnify API)")
        .when(~found & (kind == "uniprot"), "UniProt/TrEMBL identifier absent from NCBI protein (resolve via UniProt API)")
        .when(~found, "not found in NCBI protein or nuccore")
        .when(status == "suppressed", "NCBI record is suppressed")
        .when(status == "dead", "NCBI record is dead")
        .otherwise("")
    )
    return F.struct((found | other).alias("resolves"), is_protein.alias("is_protein"), is_current.alias("is_current"), (is_protein & is_current).alias("passed"), note.alias("note"))


def remap_targets(rows: DataFrame, flags: dict[str, Column], recovered: Column) -> DataFrame:
    """Rows whose accession needs to be found anew, with the reason; an obsolete one only if nothing was recovered for it."""
    label = confidence(*(flags[c] for c in ("kind", "resolves", "is_protein", "is_current", "name_flag", "paper_flag", "seq_flag", "org_flag")))
    reason = F.when((label == "obsolete_record") & (F.coalesce(recovered, F.lit("")) == ""), "obsolete_no_ipg").when(label.isin("organism_mismatch", "title_unmapped"), label)
    return rows.withColumn("target", reason).where("target is not null")


def supplement_url(doi: Column, filename: Column) -> Column:
    """Where a supplement named in an article can be fetched; null where no route is known."""
    acs = F.concat(F.lit("https://pubs.acs.org/doi/suppl/"), doi, F.lit("/suppl_file/"), filename)
    return F.when(F.startswith(F.lower(doi), F.lit("10.1021/")), acs).when(filename.rlike("^https?://"), filename)


def order_report(rows: DataFrame, id_col: str, problems: Column) -> DataFrame:
    """(kind, n, n_rows) of the problems of a column of lists, the most frequent kind first by ``place``.

    Lists cost far more than their bytes, so rows are dealt by id first; a
    small file would be one task.
    """
    every = rows.repartition(id_col).select(F.col(id_col).alias("_row"), F.explode(problems).alias("_p"))
    kinds = every.withColumn("kind", F.trim(F.split_part(F.split_part("_p", F.lit(":"), F.lit(1)), F.lit("("), F.lit(1))))
    counts = kinds.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("_row").alias("n_rows"))
    return numbered(counts, F.col("n").desc(), "kind").withColumn("place", F.col("_ord") + 1).drop("_ord")


def refuse(report: DataFrame, strict: bool) -> DataFrame:
    """With ``strict``, a query that stops if the report has rows."""
    return report.withColumn("n", F.when(F.lit(strict), F.raise_error(F.concat(F.lit("exceptions: "), "kind")).cast("long")).otherwise(F.col("n")))
