"""Vocabularies of the contract domain: clause types, their trigger patterns, deontic phrases, concepts, label sets."""

from __future__ import annotations

# The clause taxonomy, in its order (ties go to the earlier type), its gold subset, and the sentinel.
TAXONOMY = ("term", "rent", "deposit", "maintenance", "utilities", "termination", "holdover", "subletting", "access", "late_fee", "registration", "dispute_resolution", "premises", "pets", "entire_agreement", "no_obligation")
GOLD_TYPES = ("maintenance", "utilities", "subletting", "termination", "holdover", "deposit", "term")
UNKNOWN = "unknown"
# Weights of the types in the choice of the best one.
TYPE_WEIGHTS = {"term": 0.5}
RISK_LEVELS = ("high", "medium", "low", "info")

# Trigger patterns of the clause types. (?i) ignores case, (?is) also lets a dot match line ends.
TRIGGERS: dict[str, tuple[str, ...]] = {
    "term": (
        r"(?i)\bterm\s+of\s+this\s+(?:lease|tenancy|licen[cs]e)\b",
        r"(?i)\b(?:initial|renewal|extension|additional)\s+term\b",
        r"(?i)\bcommence\w*\s+date\b",
        r"(?i)\b(?:expires?|expiration)\s+(?:on|after|of)?\s*",
        r"(?i)\bfor a period of\b",
        r"(?i)\blease\s+term\b",
        r"(?i)\bexpiration\s+(?:date|of the term)\b",
    ),
    "rent": (
        r"(?i)\bbase\s+rent\b",
        r"(?i)\bmonthly\s+rent\b",
        r"(?i)\brent(?:al)?\s+(?:rate|payments?|amount|due)\b",
        r"(?i)\badditional\s+rent\b",
        r"(?i)\brent\s+shall\s+be\b",
        r"(?i)\brent(?:al)?\s+(?:for|of)\s+the\s+premises\b",
        r"(?i)\bannual\s+rent(?:al)?\b",
    ),
    "deposit": (
        r"(?i)\bsecurity\s+deposit\b",
        r"(?i)\blease\s+deposit\b",
        r"(?i)\bdeposit\s+of\s+(?:Rs\.?|INR|\$|₹)",
        r"(?i)\bdeposit\s+(?:equal\s+to|shall\s+be)\b",
        r"(?is)\b(?:refund|return|repay)\w*\s+.{0,40}\bdeposit\b",
        r"(?i)\b(?:the\s+)?deposit\s+amount\b",
    ),
    "maintenance": (
        r"(?i)\brepair\w*\s+and\s+maintenance\b",
        r"(?i)\bmainten\w*\s+(?:of|obligation|dut)",
        r"(?i)\bresponsible\s+for\s+the\s+maintenance\b",
        r"(?is)\bkeep\w*\s+.{0,20}\bin\s+good\s+(?:repair|condition)\b",
        r"(?i)\bmaintenance\s+(?:obligations?|duties?|charges?)\b",
    ),
    "utilities": (
        r"(?i)\butilities\b",
        r"(?i)\belectricit\w*\b",
        r"(?i)\bgas\s+(?:charges?|bills?|costs?)?\b",
        r"(?i)\bwater\s+(?:charges?|bills?|rates?)?\b",
        r"(?i)\bsewer\b",
        r"(?i)\bhvac\b",
        r"(?i)\bair[- ]conditioning\b",
    ),
    "termination": (
        r"(?i)\bterminat\w*\b",
        r"(?i)\bcancel\w*\s+(?:this\s+)?(?:lease|contract)\b",
        r"(?i)\b(?:right|option)\s+to\s+terminate\b",
        r"(?i)\bterminate\s+this\s+(?:lease|contract|agreement)\b",
        r"(?i)\bnot\s+renew\w*\b",
    ),
    "holdover": (
        r"(?i)\bhold\w*\s+over\b",
        r"(?i)\btenant\s+at\s+sufferance\b",
        r"(?i)\b(?:double|twice)\s+(?:the\s+)?(?:monthly\s+)?rent\b",
        r"(?i)\bdouble\s+rent\b",
        r"(?i)\b(?:remain|retain|continue)\w*\s+in\s+possession\b",
        r"(?i)\bmove\s+out\s+of\s+(?:the\s+)?(?:leasehold|premises)\b",
        r"(?i)\b(?:vacate|surrender)\w*\s+possession\b",
        r"(?is)\bfail(?:s|ed|ing|ure)?\w*\s+to\s+return\w*\s+.{0,30}\bpremises\b",
        r"(?is)\bafter\s+the\s+expiration\b.{0,40}\bpossession\b",
    ),
    "subletting": (
        r"(?i)\bsublet\w*\b",
        r"(?i)\bsubleas\w*\b",
        r"(?i)\bassign\w*\s+this\s+(?:lease|contract|agreement)\b",
        r"(?i)\bsublicen[cs]e\w*\b",
    ),
    "access": (
        r"(?i)\benter(?:ing|s|ed)?\s+(?:the\s+)?premises\b",
        r"(?i)\b(?:inspect|inspection)\w*\s+(?:the\s+)?premises\b",
        r"(?i)\b(?:repairs?|inspections?)\s+and\s+(?:repairs?|inspections?)\b",
        r"(?i)\baccess\s+to\s+(?:the\s+)?premises\b",
        r"(?i)\bright\s+of\s+entry\b",
        r"(?is)\b(?:inspect|inspection)\w*\s+.{0,30}\b(?:repair|maintenance)\b",
    ),
    "late_fee": (
        r"(?i)\blate\s+(?:fee|charge)\b",
        r"(?i)\binterest\s+(?:on|upon)\s+overdue\b",
        r"(?is)\b(?:penalt\w*|penal\s+sum)\b.{0,30}\b(?:rent|payment|overdue)\b",
        r"(?i)\bcharge\s+of\s+Rs\.?\b",
    ),
    "registration": (
        r"(?i)\bregist(?:er|ration|ered)\b",
        r"(?i)\bleasing\s+administrative\s+office\b",
        r"(?i)\b(?:approval\s+and\s+)?regist(?:er|ration)\s+with\b",
    ),
    "dispute_resolution": (
        r"(?i)\bdispute\b",
        r"(?i)\barbitrat\w*\b",
        r"(?i)\blitigat\w*\b",
        r"(?i)\bmediation\b",
        r"(?i)\bgoverning\s+law\b",
        r"(?i)\bgoverned\s+by\b",
        r"(?is)\bresolv\w*\s+.{0,20}\bdispute\b",
    ),
    "premises": (
        r"(?i)\bleased\s+to\b",
        r"(?i)\bflat\s+no\.?\b",
        r"(?i)\bdescribed\s+as\b",
        r"(?i)\bdemised?\s+premises\b",
    ),
    "pets": (
        r"(?i)\bpet(?:s)?\b",
        r"(?i)\bdomestic\s+animals?\b",
        r"(?is)\bkeep\w*\s+.{0,20}\b(?:pet|animal)\b",
    ),
    "entire_agreement": (
        r"(?i)\bentire\s+agreement\b",
        r"(?i)\bwhole\s+agreement\b",
        r"(?i)\bintegration\s+clause\b",
        r"(?i)\bmerger\s+clause\b",
        r"(?is)\bsupersed\w*\s+.{0,30}\b(?:prior|previous|representations)\b",
    ),
    "no_obligation": (
        r"(?i)\bno\s+obligation\s+to\s+(?:operate|conduct|open|maintain)\b",
        r"(?i)\bshall\s+have\s+no\s+obligation\b",
        r"(?i)\bnot\s+(?:obligated|required)\s+to\s+(?:maintain|operate|provide|open)\b",
        r"(?i)\bno\s+(?:duty|obligation)\s+to\s+relet\b",
    ),
}

# Deontic phrase groups, in order.
DEONTIC_PHRASES: dict[str, tuple[str, ...]] = {
    "obl": ("shall be responsible for", "will be responsible for", "agrees to", "agree to", "acknowledges that", "shall pay", "shall provide", "undertakes to", "represents and warrants", "shall maintain"),
    "ent": ("shall have the right to", "shall be entitled to", "will be entitled to", "has the right to", "retains all other rights", "shall have the option", "waives no rights", "right to terminate", "may at its option", "shall be permitted to"),
    "pro": ("shall not", "will not", "may not", "nor shall", "not to be", "in no event shall", "neither lessor nor lessee may", "shall be prohibited from", "no obligation to", "without the prior written consent"),
    "per": ("may", "is permitted to", "will allow", "shall be allowed to", "may at landlord's option", "shall have the right", "is authorized to", "has the right", "shall be permitted", "are permitted to"),
    "nen": ("shall have no right to", "shall not be entitled", "waives any right", "shall not have the right", "no right to", "waive the right", "shall not be entitled to", "waives the right"),
    "nobl": ("shall not be obligated", "shall not be required", "shall have no obligation", "shall have no liability", "shall not be liable", "no obligation to", "shall not bear", "shall not pay", "not responsible for", "shall not be obligated to"),
}
# Positions of a deontic label vector, and party aliases.
DEONTIC_LABELS = ("obl", "ent", "pro", "per", "oth", "nen", "none")
PARTY_ALIASES = {"lessee": "tenant", "subtenant": "tenant", "tenant": "tenant", "lessor": "landlord", "sublandlord": "landlord", "landlord": "landlord"}

# Red-flag types, entity classes, label corrections, the length at which texts were cut.
REDFLAG_TYPES = (
    "additional_remarks", "assignment_indeplaatsstelling_permitted", "break_option", "change_of_control", "compalsory_reconstraction", "damage", "expansion", "extension_period", "guarantee_transferable", "holdover",
    "landlord_repairs", "no_obligation_to_operate", "reinstatement_clause", "riders", "right_of_first_refusal_to_lease", "right_of_first_refusal_to_purchase", "services_charges", "special_stipulations", "sublease_permitted", "warrantees_of_the_owner",
)
ENTITY_CLASSES = ("designated_use", "end_date", "expiration_date_of_lease", "extension_period", "leased_space", "lessee", "lessor", "notice_period", "signing_date", "start_date", "term_of_payment", "vat")
CUT_AT = 600

# Concepts of risk annotations, matched against lower-cased text.
CONCEPTS: dict[str, str] = {
    "holdover": r"holdover|sufferance|hold\s+over",
    "deposit": r"deposit|letter\s+of\s+credit|security",
    "sole_discretion": r"sole\s+discretion|sole\s+and\s+absolute",
    "late_fee": r"late\s+fe|late\s+charg|late\s+pay|interest",
    "no_offset": r"offset|counterclaim|set-?off|without\s+deduction",
    "no_mitigate": r"mitigat",
    "jury_waiver": r"jury",
    "termination_landlord": r"terminat.{0,60}landlord|landlord.{0,60}terminat|unilateral",
    "go_dark": r"go-?dark|no obligation to operate|cease operations|cease business",
    "one_way_indemnity": r"one-?way|no reciprocal.*indemn|indemnif",
    "change_of_control": r"change of control|merger|consolidat|sale of",
    "guaranty_transfer": r"guarant.*(?:transfer|assign)|transfer.*guarant",
    "rent_escalation": r"escalat|increas|index|compounding|step-?up",
    "uncapped_passthrough": r"uncapped|no stated cap|pass-?through|proportionate share",
    "liability_disclaim": r"no liability|disclaim|shall not be liable",
    "weak_warranty": r"warrant.*knowledge|as of the date|to its knowledge",
    "incorporation_by_ref": r"incorporat.*reference|rider|handbook|master lease.*reference",
    "contra_proferentem": r"contra proferentem|construed against|ambiguity",
    "access_control": r"access|advance notice",
    "arbitration": r"arbitrat|mediation",
    "termination_restriction": r"lock-?in|no early exit|no early termination",
    "upfront_payment": r"upfront|in full prior|installment",
    "registration": r"stamp duty|registration|record",
    "insurance": r"insurance|indemnif",
    "automatic_termination": r"automatically terminated|auto-?termination",
    "reinstatement_window": r"reinstatement|45-day|180 days",
    "fee_shifting": r"prevailing party|fee-?shift",
    "no_renewal": r"no renewal",
}
