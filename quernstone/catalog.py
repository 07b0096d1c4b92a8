"""What is asked of a corpus: fields with keyword queries, rules, weights and thresholds.

All of it is data. The engine takes any catalog; DOMAIN is the one it ships with.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

WINDOW, STRIDE = 512, 384
K1, B, DELTA = 1.5, 0.75, 1.0
CANDIDATES, FINAL, MIN_SCORE, ALPHA = 15, 5, 1.0, 0.6
SEARCH_K = 50
REVIEW_BELOW = 0.5
REPEATED_LINES = 5
MIN_WORDS = 50
MATURITY = ((80.0, "L5 Optimising"), (65.0, "L4 Managed"), (50.0, "L3 Defined"), (35.0, "L2 Developing"), (None, "L1 Initial"))
LABELS = ((65.0, "COMPLIANT"), (35.0, "PARTIAL"), (None, "NON_COMPLIANT"))
#: Name, upper bound (exclusive), how many fields of it are shown.
BANDS = (("weak", 50.0, 3), ("medium", 65.0, 2), ("strong", None, 2))
SNIPPET = 200


@dataclass(frozen=True)
class Field:
    name: str
    control: str
    query: str


@dataclass(frozen=True)
class Rule:
    """A nullable vote on a text. kind:
    any: the first of `patterns` is found;
    all: every pattern is found;
    count: so many patterns are found as the first of `steps` (at least, value) asks;
    tiers: every pattern is found (value), or only the first of them (steps[0][1]);
    own: what `build` makes of the text's Column, a nullable number;
    and `unless` is not found."""

    name: str
    control: str
    kind: str
    patterns: tuple[str, ...]
    value: float = 1.0
    steps: tuple[tuple[int, float], ...] = ()
    unless: str | None = None
    build: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class Catalog:
    fields: tuple[Field, ...]
    rules: tuple[Rule, ...]
    weights: dict[str, float] = field(default_factory=dict)

    @property
    def controls(self) -> list[str]:
        return list(dict.fromkeys(f.control for f in self.fields))


# Queries, patterns and weights on which the scores depend.
FIELDS = (
    Field("PC1_register", "PC1", "CII asset register identification categorization critical infrastructure"),
    Field("PC1_criteria", "PC1", "six criteria functionality criticality complementarity PESS strategic time duration"),
    Field("PC1_review", "PC1", "periodic review update CII identification annual semi-annual"),
    Field("PC1_weakness", "PC1", "no register excluded SCADA OT ad hoc undocumented informal"),
    Field("PC1_strength", "PC1", "sign-off submitted NCIIPC formal process documented approved"),
    Field("PC2_vertical", "PC2", "vertical interdependency sector organisation division group supervision information flow"),
    Field("PC2_horizontal", "PC2", "horizontal interdependency matrix inbound outbound dependency peer organisation"),
    Field("PC2_weakness", "PC2", "no map not updated missing outbound no criticality rating"),
    Field("PC2_strength", "PC2", "SLA failover documented version controlled acknowledged"),
    Field("PC3_ciso", "PC3", "CISO chief information security officer reports head organisation"),
    Field("PC3_isd", "PC3", "information security department ISD established charter independent"),
    Field("PC3_soc", "PC3", "SOC security operations centre 24x7 continuous monitoring"),
    Field("PC3_audit", "PC3", "audit pentest team independent separate not report CISO"),
    Field("PC3_functions", "PC3", "planning development management oversight four functions ISD"),
    Field("PC3_weakness", "PC3", "no CISO conflict of interest reports CTO no SOC business hours paper only"),
)
RULES = (
    Rule("pc1_register_exists", "PC1", "any", (r"cii\s+(asset\s+)?register|critical.*infrastructure.*list",)),
    Rule(
        "pc1_six_criteria",
        "PC1",
        "count",
        ("functionality", r"criticality|critical\s+scale", "complementar", "pess|political.*economic.*social.*security", r"strategic\s+(value|importance)", r"time\s+duration|duration\s+of\s+(disruption|impact)"),
        steps=((5, 1.0), (3, 0.5)),
    ),
    Rule("pc1_no_register", "PC1", "any", ("(no|without|lack).{0,40}(cii register|asset register)",), 0.0),
    Rule("pc1_review_exists", "PC1", "any", ("(periodic|annual|semi.annual).{0,40}review.{0,40}(cii|critical infra)",)),
    Rule("pc1_scada_excluded", "PC1", "any", ("(scada|ot system|operational tech).{0,60}(excluded|not included|exempt)",), 0.0),
    Rule("pc1_ad_hoc", "PC1", "all", ("ad.hoc|no.{0,20}formal process|undocumented", "(cii|critical infrastructure)"), 0.0),
    Rule("pc2_both_maps", "PC2", "count", ("vertical.{0,60}interdepend", "horizontal.{0,60}interdepend"), steps=((2, 1.0), (1, 0.5))),
    Rule("pc2_matrix_exists", "PC2", "any", ("dependency matrix|interdependency matrix",)),
    Rule("pc2_inbound_outbound", "PC2", "all", ("in.?bound", "out.?bound")),
    Rule("pc2_no_mapping", "PC2", "any", ("no.{0,40}(interdependency|dependency).{0,20}(map|matrix|document)",), 0.0),
    Rule("pc2_grid_dependency", "PC2", "any", ("(grid|transmission|generation).{0,80}(interdepend|depend)",)),
    Rule("pc2_not_updated", "PC2", "any", ("(not updated|outdated|stale).{0,60}(map|matrix|interdependency)",), 0.0),
    Rule("pc3_ciso_reports_head", "PC3", "any", (r"ciso.{0,80}reports?\s+(directly\s+)?to.{0,40}(head|chairman|ceo|md|board)",)),
    Rule("pc3_ciso_wrong_report", "PC3", "any", ("ciso.{0,60}reports?.{0,20}(cto|it head|it director)",), 0.0),
    Rule("pc3_isd_exists", "PC3", "any", ("information security department|isd.{0,20}(established|formed)",)),
    Rule("pc3_no_isd", "PC3", "any", ("(no|without|lack).{0,30}(isd|information security department)",), 0.0),
    Rule(
        "pc3_soc_24x7",
        "PC3",
        "tiers",
        ("(soc|security operation)", "(24.?7|round.the.clock|continuous monitoring)"),
        steps=((1, 0.5),),
        unless="(no|without|lack).{0,30}(soc|security operation)",
    ),
    Rule("pc3_no_soc", "PC3", "any", ("(no|without|lack).{0,30}(soc|security operation)",), 0.0),
    Rule("pc3_audit_independent", "PC3", "any", ("audit.{0,60}(independent|separate).{0,60}(ciso|isd)",)),
    Rule("pc3_four_functions", "PC3", "count", ("planning", "development", "management", "oversight"), steps=((3, 1.0), (2, 0.5))),
)
TITLES = {"weak": "Weak area", "medium": "Partial area", "strong": "Strong area"}
WEIGHTS = {"PC1": 1.00, "PC2": 0.90, "PC3": 0.95}
INJECTION = (
    r"ignore\s+(all\s+)?(the\s+)?(above|previous|prior)\s+(instructions?|prompts?|rules)",
    r"disregard\s+(all\s+)?(the\s+)?(above|previous|prior)\s+(instructions?|rules)",
    r"you\s+are\s+now\s+(a|an)\b",
    r"new\s+(system\s+)?(instructions?|prompt)\s*:",
    r"system\s*:\s*you\s+(are|must|should)",
    r"reveal\s+(your|the)\s+(system\s+)?(prompt|instructions)",
    r"print\s+(your|the)\s+(system\s+)?prompt",
    r"do\s+not\s+(follow|obey)\s+(the\s+)?(rules|instructions)\s+(above|below)",
    r"override\s+(your|the)\s+(instructions?|programming|guidelines)",
    r"\b(always|only)\s+(respond|answer|vote)\s+(with\s+)?compliant",
    r"mark\s+this\s+(as\s+|field\s+)?compliant",
)
#: Applied one after another. Name, pattern, whether case matters.
REDACTIONS = (
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", True),
    ("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", True),
    ("phone", r"\b\+?\d{1,3}[-.\s]\d{3,4}[-.\s]\d{3,4}\b", True),
    ("api_key", r"\b(?:sk|pk|api|key|token)[-_][A-Za-z0-9]{16,}\b", False),
)
# End of fixed values.

DOMAIN = Catalog(FIELDS, RULES, WEIGHTS)
