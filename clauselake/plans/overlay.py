"""Test texts: short clauses that are laid over the documents, small chunks to ground on, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (gold type, clause). Our own wording; one or more for each clause type and rule, and some that must not fire.
CLAUSES: tuple[tuple[str, str], ...] = (
    ("term", "The initial term of this lease runs from the commencement date for a period of three years."),
    ("term", "The lease term ends on the expiration date. The owner warrants, to its knowledge, that the roof is sound."),
    ("term", "This lease shall automatically terminate when the additional term ends."),
    ("rent", "Base rent is $2,400 per month. Rent shall be paid without deduction or offset."),
    ("rent", "The monthly rent shall increase by 5 percent every 12 months."),
    ("rent", "Additional rent covers operating expenses; the tenant pays its proportionate share."),
    ("rent", "The full rent for the premises is payable in advance at signing."),
    ("rent", "The annual rental amount may be raised in the sole discretion of the landlord."),
    ("deposit", "A security deposit of $4,800 is due at signing."),
    ("deposit", "No security deposit is required from this tenant."),
    ("deposit", "The lease deposit is backed by a guaranty that is transferable to any successor."),
    ("deposit", "The owner will refund the whole deposit amount, Rs. 12,500, after a letter of credit is returned."),
    ("maintenance", "The tenant is responsible for the maintenance of the yard and shall keep it in good repair."),
    ("maintenance", "Maintenance duties: the landlord is not liable for theft or vandalism."),
    ("maintenance", "Repairs and maintenance of pipes. The rider attached hereto is incorporated here by reference."),
    ("maintenance", "On leaving, the tenant shall restore the rooms to their original condition; maintenance charges apply."),
    ("utilities", "Electricity, gas charges, water bills and sewer are paid by the tenant."),
    ("utilities", "The cost of hvac and air-conditioning service is borne by the tenant as a pass-through."),
    ("termination", "The landlord may terminate this lease at any time."),
    ("termination", "The tenant may not cancel this contract and has no right to terminate early."),
    ("termination", "On termination the landlord has no duty to mitigate."),
    ("termination", "Either side may choose not to renew; a termination notice refunds no deposit."),
    ("holdover", "A tenant at sufferance who continues in possession pays double rent."),
    ("holdover", "If the tenant fails to return the premises, 150 percent of the rent is due."),
    ("subletting", "The tenant shall not sublet or assign this lease; a merger or change of control of 50% counts as transfer."),
    ("access", "The landlord may enter the premises at all times without notice for inspections and repairs."),
    ("access", "The owner has a right of entry and access to the premises upon two days of warning."),
    ("late_fee", "A late fee of 8% is due within 10 days. Interest on overdue sums runs at 12 percent."),
    ("registration", "Registration and stamp duty are a cost that the tenant shall pay at the leasing administrative office."),
    ("dispute_resolution", "Any dispute goes to binding arbitration; the parties waive their right to a jury trial."),
    ("dispute_resolution", "The tenant shall indemnify the landlord. The governing law is local law; an ambiguity is not construed against the drafting side."),
    ("dispute_resolution", "In litigation the tenant shall pay all attorney's fees of the landlord."),
    ("premises", "The rooms described as flat no. 7 are leased to the tenant; the landlord has no liability for loss."),
    ("premises", "The demised premises carry insurance; the landlord's premium is a cost of the tenant."),
    ("pets", "No pets or domestic animals are allowed."),
    ("entire_agreement", "This is the entire agreement and supersedes all prior promises."),
    ("no_obligation", "The tenant has no obligation to operate a shop and may cease business."),
    ("unknown", "The premises are clean and the windows face south."),
    ("unknown", "1. Quiet Hours\nHours run from ten to six.\n2. Keys\nTwo keys are handed over.\n\nClosing Words\nSigned in two copies."),
    ("unknown", "(a) First point of the list\r\n(b) Second point of the list\r\n\r\nlower case tail\nof a wrapped line."),
    ("unknown", "Parking\nOne space is kept.\nStorage Room\nThe cellar is dry.\n6-1 Extra rules\nNone so far."),
)
CHUNKS: tuple[tuple[str, str], ...] = (
    ("s11", "The security deposit shall not exceed two months of rent for a home."),
    ("s9", "A revision of the rent above ten percent needs notice."),
    ("s10", "A later revision of rent by a percent follows section nine."),
    ("s23", "A holdover tenant at sufferance owes twice the rent."),
    ("s7", "On termination the tenant and the landlord give notice."),
    ("s15", "Access to the premises by the landlord needs a notice of one day."),
    ("s20", "Insurance is a cost that the tenant may share."),
    ("s30", "Arbitration is binding in a dispute of small value."),
    ("s31", "Fees of an attorney are not shifted to the tenant."),
    ("s40", "Operating expense: a capital reserve is annual."),
    ("s41", "Nothing here is about anything."),
)


def clause_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate(CLAUSES)], "k int, gold string, clause_text string")


def chunk_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(CHUNKS)], "chunk_idx int, id string, text string")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, k, gold, source, text): every document with a clause before its whole text, in ASCII."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    if docs.rdd.getNumPartitions() < (cores := spark.sparkContext.defaultParallelism):
        docs = docs.repartition(cores)  # a file or two: patterns over whole texts are worth a move
    clauses = F.broadcast(clause_table(spark))  # a table of fixed size
    rest = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20-\x7e]", " ")
    rows = docs.join(clauses, F.col("doc_id") % len(CLAUSES) == F.col("k"))
    return rows.select(F.col("doc_id").alias("id"), "k", "gold", "source", F.concat("clause_text", F.lit("\n\n"), rest).alias("text"))


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


CLAUSE_SQL = "clause_dim(k, gold, clause_text) AS (VALUES " + ", ".join(f"({i}, {quoted(g)}, {quoted(t)})" for i, (g, t) in enumerate(CLAUSES)) + ")"
CHUNK_SQL = "chunk_dim(chunk_idx, id, text) AS (VALUES " + ", ".join(f"({i}, {quoted(k)}, {quoted(t)})" for i, (k, t) in enumerate(CHUNKS)) + ")"
SECTIONS_SQL = (
    CLAUSE_SQL
    + f", sections AS (SELECT d.doc_id AS id, c.k, c.gold, d.source, c.clause_text || chr(10) || chr(10) || regexp_replace(coalesce(d.text, ''), '[^\\x20-\\x7e]', ' ', 'g') AS text"
    + f" FROM documents d JOIN clause_dim c ON d.doc_id % {len(CLAUSES)} = c.k)"
)
