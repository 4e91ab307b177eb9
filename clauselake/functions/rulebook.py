"""The shipped risk rules, as data."""

from __future__ import annotations

from dataclasses import dataclass, field

# Amounts and percentages, and everything in RULES.
AMOUNT = r"(?:\$|Rs\.?|INR|₹)\s*([\d,]+(?:\.\d+)?)"
PERCENT = r"(?i)(\d+(?:\.\d+)?)\s*(?:%|percent)"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    clause_types: tuple[str, ...]
    level: str
    triggers: tuple[str, ...]
    rationale: str
    query: str
    anchors: tuple[str, ...]
    fallback: str = "general"
    exclusions: tuple[str, ...] = ()
    extractors: dict[str, str] = field(default_factory=dict)
    concept: str | None = None


RULES: tuple[Rule, ...] = (
    Rule(
        "deposit.cap_exceeded", ("deposit", "rent", "late_fee"), "medium",
        (r"(?is)\bsecurity\s+deposit\b|\bletter\s+of\s+credit\b|\bdeposit\s+(?:of|shall|to|required|payable|held|for|is|equal\s+to|equaling|equal\b)\b|\b(?:as\s+a?\s+deposit|lease\s+security|guaranty\s+money)\b|\bsecurity\b.{0,60}\b(?:twice|double|equal\w*|equivalent\w*)\b.{0,40}\brent\b",),
        "Security deposit clause detected. Verify deposit does not exceed statutory cap (MTA s.11: max 2 months rent). Extracted: {deposit_amount}",
        "security deposit cap maximum two months rent", ("deposit", "two months", "rent", "not exceed"), "MTA 2021 s.11(1)(a)",
        (r"(?i)\bno\s+security\s+deposit\b|\bsecurity\s+deposit\s+(?:is\s+)?not\s+required\b",),
        {"deposit_amount": rf"(?is){AMOUNT}.{{0,40}}\b(?:security\s+)?deposit\b|(?:security\s+)?deposit\b.{{0,40}}?{AMOUNT}|{AMOUNT}.{{0,40}}\bletter\s+of\s+credit\b"},
        "deposit",
    ),
    Rule(
        "deposit.guaranty_transfer", ("deposit",), "low", (r"(?i)\bguarant\w*\b", r"(?i)\btransfer\w*|\bassign\w*|\bsuccess\w*\b"),
        "Guaranty appears transferable to assignees or successors without requiring a new guaranty instrument.",
        "guaranty assignment transfer successor", ("guaranty", "assign", "transfer"), concept="guaranty_transfer",
    ),
    Rule(
        "rent.excessive_escalation", ("rent",), "medium",
        (r"(?i)\b(?:increas\w*|escalat\w*|adjust\w*|revision|revis\w*|index\w*)\b", r"(?i)\b(?:every|annual|yearly|per\s+year|each\s+year|compounding|year-over-year|per\s+annum)\b"),
        "Rent escalation clause detected. Verify increase cadence and percentage are within norms. Extracted: {pct}",
        "rent increase revision percentage limit annual cap", ("revision", "rent", "percent"), "MTA 2021 s.9",
        extractors={"pct": PERCENT, "cadence": r"(?i)every\s+(\d+)\s+(month|months|year|years)"}, concept="rent_escalation",
    ),
    Rule(
        "rent.no_offset", ("rent",), "medium",
        (r"(?is)\b(?:without|no|not)\s+(?:deduction|offset|counterclaim|abatement)\b|\bwaive\w*\s+.{0,30}\b(?:offset|counterclaim|deduction|abatement)\b",),
        "Tenant waives right to offset or counterclaim against rent, removing a key self-help remedy for landlord non-performance.",
        "rent offset counterclaim waiver tenant remedy", ("rent", "offset", "counterclaim"), concept="no_offset",
    ),
    Rule(
        "rent.uncapped_passthrough", ("rent", "utilities"), "medium",
        (r"(?i)\b(?:operat\w*|cam|common\s+area|maintenance|tax|insurance|expense\w*|utility\w*|service)\b", r"(?i)\b(?:pass[- ]?through|tenant.*share|proportionate|reimburs\w*|undertak\w*|borne\s+by)\b"),
        "Operating expense passthrough has no stated annual cap, exposing tenant to uncapped cost growth.",
        "operating expense cap annual limit pass-through", ("operating", "expense", "cap", "annual"), concept="uncapped_passthrough",
    ),
    Rule(
        "holdover.punitive_rate", ("holdover", "term"), "medium",
        (r"(?is)\bhold\w*\s+over\b|\btenant\s+at\s+sufferance\b|\bfail\w*\s+to\s+vacate\b|\bremain\w*\s+in\s+possession\b|\b(?:fails?\s+to\s+return|shall\s+return|move\s+out|does\s+not\s+move\s+out)\b.{0,60}\b(?:double|twice|\d+(?:\.\d+)?\s*(?:%|percent))\b.{0,30}\b(?:rent|rental|penalty)\b|\bdouble\s+rent\b|\btwice\s+the\s+rent\b",),
        "Holdover penalty clause detected. Verify penalty rate is reasonable. Extracted multiplier: {multiplier}",
        "holdover tenant sufferance rent multiplier penalty", ("holdover", "sufferance", "rent"), "MTA 2021 s.23",
        extractors={"multiplier": r"(?i)(\d+(?:\.\d+)?)\s*(?:%|percent)|(double|twice|triple)"}, concept="holdover",
    ),
    Rule(
        "late_fee.excessive", ("late_fee",), "medium", (r"(?i)\blate\s+(?:fee|charge|payment)\b|\binterest.*overdue\b|\binterest\s+at\s+\d+\s*(?:%|percent)\b",),
        "Late fee clause detected. Verify fee rate is within jurisdictional norms. Extracted: {pct}",
        "late fee penalty rent maximum percentage", ("late fee", "interest", "rent"), extractors={"pct": PERCENT, "days": r"(?i)within\s+(\d+)\s+days"}, concept="late_fee",
    ),
    Rule(
        "termination.landlord_only", ("termination",), "low",
        (r"(?i)\b(?:landlord|lessor)\s+(?:may|shall|can|is\s+entitled\s+to)\s+terminat|\b(?:landlord|lessor).*terminat\w*\s+(?:this|the)\s+(?:lease|agreement)\b",),
        "Termination right appears to be granted to Landlord only. Check for corresponding Tenant termination right.",
        "termination right tenant landlord mutual", ("termination", "tenant", "landlord"), "MTA 2021 s.7", concept="termination_landlord",
    ),
    Rule(
        "termination.sole_discretion", ("termination", "rent"), "low", (r"(?i)\bsole\s+discretion\b",),
        "Clause uses 'sole discretion' language, which gives the landlord unilateral control. This may limit tenant remedies.",
        "sole discretion landlord obligation good faith", ("sole discretion", "landlord"), concept="sole_discretion",
    ),
    Rule(
        "subletting.change_of_control", ("subletting",), "low",
        (r"(?i)\bchange\s+of\s+control\b|\bchange\s+in\s+(?:management|ownership|control)\b|\bequity\s+transfer\b|\bvoting\s+(?:interest|threshold|percent)\b|\bmerger\b|\bconsolidat\w*\b|\bsale\s+of\s+(?:substantially\s+)?all\b",),
        "Change-of-control consent provision detected. Verify threshold is reasonable. Extracted threshold: {threshold}",
        "change of control consent equity threshold assignment", ("change", "control", "consent", "assignment"), extractors={"threshold": r"(?i)(\d+)\s*%"}, concept="change_of_control",
    ),
    Rule(
        "dispute_resolution.jury_waiver", ("dispute_resolution",), "info", (r"(?i)\b(?:waive|waiver|right\s+to)\s+.{0,20}\bjury\b|\bjury\s+(?:trial|verdict|right)\b",),
        "Tenant waives jury trial right, removing access to jury in lease-related litigation.", "jury trial waiver tenant right lease", ("jury", "trial", "waive"), concept="jury_waiver",
    ),
    Rule(
        "dispute_resolution.one_way_indemnity", ("dispute_resolution",), "info", (r"(?i)\bindemn\w*\b", r"(?i)\b(?:lessee|tenant)\s+(?:shall|will|agrees?\s+to)\s+indemnif|\b(?:runs?\s+from|one[- ]?way)\b"),
        "Indemnification obligation appears to run one-way from tenant to landlord with no reciprocal landlord indemnity.",
        "indemnity mutual obligation landlord tenant", ("indemnity", "tenant", "landlord"), concept="one_way_indemnity",
    ),
    Rule(
        "dispute_resolution.contra_proferentem", ("dispute_resolution",), "info", (r"(?is)\bcontra\s+proferentem\b|\bambiguit\w*.{0,40}\bconstrued\s+against|\bnot\s+construed\s+against\s+(?:the\s+)?drafting\b",),
        "Clause waives the contra proferentem interpretation rule, removing a tenant-protective ambiguity resolution principle.",
        "contra proferentem ambiguity drafting party interpretation", ("ambiguity", "construed", "drafting"), concept="contra_proferentem",
    ),
    Rule(
        "maintenance.liability_disclaim", ("maintenance", "premises"), "low",
        (r"(?i)\bliab\w*\b", r"(?is)\b(?:not|no|shall\s+not)\b.{0,40}\b(?:theft|vandal\w*|loss|damage)\b|\b(?:theft|vandal\w*|loss)\b.{0,40}\b(?:not|no)\b"),
        "Landlord disclaims liability for theft or vandalism of tenant property, shifting security-related loss risk entirely to tenant.",
        "landlord liability tenant property theft vandalism", ("liability", "tenant", "property"), concept="liability_disclaim",
    ),
    Rule(
        "maintenance.weak_warranty", ("maintenance", "premises", "term"), "info", (r"(?i)\bwarrant\w*\b", r"(?i)\bto\s+its\s+knowledge\b|\bas\s+of\s+the\s+date\b"),
        "Warranty or representation is qualified 'to its knowledge' or 'as of the date', materially weakening the protection.",
        "warranty knowledge qualifier landlord representation", ("warranty", "knowledge", "landlord"), concept="weak_warranty",
    ),
    Rule(
        "maintenance.incorporation_by_ref", ("maintenance", "utilities", "termination"), "info",
        (r"(?is)\b(?:incorporat\w*|made\s+a\s+part)\s+.{0,20}\bby\s+reference\b|\b(?:rider|schedule|annex|exhibit|addendum|appendix)\b.{0,30}\b(?:attached|enclosed|hereto)\b|\b(?:rider|addendum|appendix)\b",),
        "Terms are incorporated by reference without reproduction in the document, creating a blind spot for review.",
        "incorporation by reference terms schedule rider", ("incorporated", "reference", "schedule"), concept="incorporation_by_ref",
    ),
    Rule(
        "termination.no_mitigate", ("termination", "rent"), "low",
        (r"(?is)\bno\s+(?:duty|obligation)\s+to\s+mitigat|\bnot\s+(?:required|obligated)\s+to\s+mitigat|\bmitigat\w*\s+.{0,30}\b(?:beyond|greater\s+than)\s+.{0,20}\blaw\b",),
        "Landlord has no duty to mitigate damages beyond what law requires, increasing tenant exposure on default.",
        "duty to mitigate damages landlord tenant default", ("mitigate", "damages", "landlord"), concept="no_mitigate",
    ),
    Rule(
        "access.unrestricted_entry", ("access", "premises", "maintenance", "utilities"), "low",
        (
            r"(?i)\b(?:landlord|lessor|owner|landlord'?s?\s+(?:agents?|representatives?|employees?))\b",
            r"(?i)\b(?:enter|access|inspect|examine|tour)\w*\b",
            r"(?i)\b(?:at\s+any\s+time|at\s+all\s+times|without\s+(?:notice|prior\s+notice|permission|advance\s+notice)|upon\s+demand|at\s+will)\b",
        ),
        "Landlord retains unrestricted access to the premises (any time or without notice), which can disrupt tenant operations.",
        "landlord access premises notice inspection quiet enjoyment", ("access", "notice", "premises", "landlord"), concept="access_control",
    ),
    Rule(
        "transaction.registration_costs", ("registration", "rent", "term", "termination"), "low",
        (r"(?i)\b(?:stamp\s+duty|registration|registry|notariz\w*)\b", r"(?i)\b(?:tenant|lessee)\b", r"(?i)\b(?:bear|pay|cost|expense|charge|liab\w*|borne|incurred)\b"),
        "Stamp duty and registration costs are placed on the Tenant. Verify the applicable duty (stamp duty can be several percent of rent) is not an outsized, landlord-shifting burden.",
        "lease registration stamp duty tenant cost", ("registration", "stamp duty", "tenant", "cost"), concept="registration",
    ),
    Rule(
        "reinstatement.as_is_restoration", ("maintenance", "premises", "term", "termination"), "low",
        (r"(?i)\b(?:restore|restoration|reinstat\w*)\b", r"(?i)\b(?:original\s+condition|as\s+it\s+was|as\s+it\s+existed|prior\s+to|same\s+condition|as\s+is)\b"),
        "Tenant must restore the premises to its original condition, including ordinary wear-and-tear items. Verify scope of the restoration obligation.",
        "reinstatement restoration original condition tenant surrender", ("restore", "condition", "tenant"), concept="reinstatement_window",
    ),
    Rule(
        "dispute_resolution.mandatory_arbitration", ("dispute_resolution", "termination", "rent"), "info",
        (r"(?i)\barbitrat\w*\b", r"(?i)\b(?:binding|final|exclusive\s+means|in\s+lieu\s+of|sole\s+remedy)\b|\bshall\s+(?:submit|be\s+settled|be\s+resolved)\b"),
        "Disputes must be resolved by binding arbitration, waiving court access for tenant claims.", "arbitration binding dispute resolution tenant", ("arbitration", "binding", "dispute"), concept="arbitration",
    ),
    Rule(
        "dispute_resolution.fee_shifting", ("dispute_resolution", "rent", "termination"), "info",
        (r"(?i)\b(?:attorney'?s?\s+fees?|attorney\s+costs?|legal\s+fees?|lawyers?\s+fees?|solicitor'?s?\s+fees?)\b", r"(?i)\b(?:tenant|lessee)\b", r"(?i)\b(?:pay|bear|reimburs\w*|cost|expense)\b"),
        "Attorney-fee obligation is placed on the Tenant. Verify fee-shifting is not one-way in the landlord's favor.",
        "attorney fees prevailing party fee shifting tenant", ("fees", "attorney", "tenant"), concept="fee_shifting",
    ),
    Rule(
        "termination.no_early_exit", ("termination", "rent", "term"), "low",
        (r"(?i)\b(?:tenant|lessee)\b", r"(?i)\b(?:no\s+right|may\s+not|shall\s+not|is\s+not\s+entitled|has\s+no\s+right|without\s+the\s+right)\b", r"(?i)\b(?:terminat\w*|cancel\w*|break)\b"),
        "Tenant has no early-termination right for the lease term, creating a lock-in risk.", "tenant early termination right lock in", ("termination", "tenant", "right"), concept="termination_restriction",
    ),
    Rule(
        "termination.automatic", ("termination", "term"), "info",
        (r"(?i)\b(?:shall\s+)?(?:be\s+deemed\s+)?(?:automatically\s+terminat\w*|automatically\s+expire|terminat\w*\s+automatically|expire\s+automatically)\b",),
        "Lease terminates automatically upon a stated event, removing tenant tenure security. Verify the triggering event.", "automatic termination event lease tenant", ("termination", "automatic"), concept="automatic_termination",
    ),
    Rule(
        "rent.upfront_payment", ("rent", "deposit"), "low",
        (r"(?is)\b(?:full|entire|whole)\s+(?:rent|rental|annual\s+rent)\b.{0,60}\b(?:in\s+advance|prior\s+to|at\s+signing|upon\s+execution|before\s+possession)\b|\b(?:rent|rental|license\s+fee|payment|installment)\b.{0,60}\b(?:due\s+in\s+full|payable\s+in\s+full)\b.{0,40}\b(?:prior\s+to|before|in\s+advance|at\s+signing|upon\s+execution)\b",),
        "Full rent is payable in advance at signing, an outsized upfront cash commitment for the tenant.", "rent advance payment full term upfront tenant", ("rent", "advance", "payment"), concept="upfront_payment",
    ),
    Rule(
        "insurance.tenant_pays_all", ("maintenance", "premises", "rent", "utilities"), "info",
        (r"(?i)\binsurance\b", r"(?i)\b(?:landlord'?s?|owner'?s?|lessor'?s?)\b", r"(?i)\b(?:cost|expense|premium|reimburs\w*|bear|pay\w*)\b"),
        "Tenant bears costs for the Landlord's insurance. Verify the insurance-cost allocation is not one-sided.", "insurance premiums tenant landlord cost allocation", ("insurance", "tenant", "cost"), concept="insurance",
    ),
    Rule(
        "no_obligation.go_dark", ("no_obligation",), "info",
        (r"(?i)\bno\s+(?:obligation|duty|requirement)\s+to\s+(?:operate|conduct|open|maintain)\b|\bmay\s+cease\s+(?:operations?|business|conducting)\b",),
        "Tenant may cease operations without breach. Verify this does not conflict with co-tenancy or percentage-rent provisions.",
        "no obligation operate tenant cease operations", ("obligation", "operate", "tenant"), concept="go_dark",
    ),
)
