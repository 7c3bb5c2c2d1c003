"""Parameters and fixed values shared by the operators.

Everything that an examiner may tune is a field of a frozen dataclass; everything
that has to keep one exact value for results to be right is a plain constant.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: severity and criticality vocabularies -------------------------------
SEVERITY_ALIASES = {
    "CRITICAL": ["CRITICAL", "CRIT", "P1", "SEV-1", "SEV1", "5"],
    "HIGH": ["HIGH", "P2", "SEV-2", "SEV2", "4"],
    "MEDIUM": ["MEDIUM", "MED", "P3", "SEV-3", "SEV3", "3"],
    "LOW": ["LOW", "P4", "SEV-4", "SEV4", "2"],
    "INFO": ["INFO", "INFORMATIONAL", "P5", "SEV-5", "1"],
}
CRITICALITY_ALIASES = {
    "CRITICAL": ["CRITICAL", "TIER_1"],
    "HIGH": ["HIGH", "TIER_2"],
    "MEDIUM": ["MEDIUM", "TIER_3"],
    "LOW": ["LOW"],
}
SOC_LOG_SEVERITIES = {
    "CRITICAL": ["1", "CRITICAL", "VERY_HIGH"],
    "HIGH": ["2", "HIGH"],
    "MEDIUM": ["3", "MEDIUM", "MED"],
}

# --- fixed values: evidence types required before a finding counts as complete ---------
_GAP_TYPES = ["DIRECT_RECORD", "MISSING_EXPECTED_RECORD", "WORKFLOW_TRANSITION", "DATA_QUALITY"]
EVIDENCE_CONTRACT = {
    "GAP-01": _GAP_TYPES,
    "GAP-02": _GAP_TYPES,
    "GAP-03": _GAP_TYPES,
    "GAP-04": _GAP_TYPES,
    "GAP-05": _GAP_TYPES,
    "GAP-06": _GAP_TYPES,
    "NEG-01": ["DIRECT_RECORD", "MISSING_EXPECTED_RECORD", "CONTEXT_SUPPRESSION", "DATA_QUALITY"],
    "NEG-02": ["DIRECT_RECORD", "HISTORICAL_BASELINE", "STATISTICAL_DEVIATION", "DATA_QUALITY"],
    "NEG-03": ["DIRECT_RECORD", "MISSING_EXPECTED_RECORD", "DATA_QUALITY"],
    "NEG-04": ["DIRECT_RECORD", "PEER_COMPARISON", "STATISTICAL_DEVIATION", "DATA_QUALITY"],
    "NEG-05": ["DIRECT_RECORD", "CONTEXT_SUPPRESSION", "DATA_QUALITY"],
}
DEFAULT_CONTRACT = ["DIRECT_RECORD", "DATA_QUALITY"]

# --- fixed values: rule to ATT&CK technique, mapping type, confidence -------------------
RULE_TECHNIQUES = [
    ("GAP-01", "T1562", "SUPPORTED_INFERENCE", 0.85),
    ("GAP-02", "T1562.001", "SUPPORTED_INFERENCE", 0.80),
    ("GAP-03", "T1078", "SUPPORTED_INFERENCE", 0.75),
    ("GAP-04", "T1070", "SUPPORTED_INFERENCE", 0.75),
    ("GAP-05", "T1068", "SUPPORTED_INFERENCE", 0.80),
    ("GAP-06", "T1486", "SUPPORTED_INFERENCE", 0.90),
    ("NEG-01", "T1562.002", "DIRECT", 1.0),
    ("NEG-02", "T1562", "SUPPORTED_INFERENCE", 0.85),
    ("NEG-03", "T1070.001", "DIRECT", 1.0),
    ("NEG-04", "T1190", "SUPPORTED_INFERENCE", 0.80),
    ("NEG-05", "T1078", "SUPPORTED_INFERENCE", 0.75),
]

# --- fixed values: software assumed on each asset type (type, vendor, product, version, group)
ASSET_PROFILES = [
    ("WEB_SERVER", "apache", "log4j", "2.14.1", "APT29"),
    ("APPLICATION_GATEWAY", "citrix", "netscaler_adc", "13.1", "FIN7"),
    ("DOMAIN_CONTROLLER", "microsoft", "windows_server_2019", "*", "Wizard Spider"),
    ("FILE_TRANSFER_SERVER", "progress", "moveit_transfer", "2023.0.0", "FIN7"),
    ("REMOTE_ACCESS_VPN", "ivanti", "connect_secure", "9.1", "APT29"),
    ("EMAIL_GATEWAY", "barracuda", "email_security_gateway", "*", "APT28"),
    ("REMOTE_SUPPORT", "connectwise", "screenconnect", "23.9.7", "Lazarus Group"),
]

# --- fixed values: the rule register (rule, version, name, family, severity, base risk) -
RULE_REGISTER = [
    ("GAP-01", "1.0.0", "Severe alert ended below supervisor level", "EXECUTION_GAP", "CRITICAL", 30.0),
    ("GAP-02", "1.0.0", "Serious alert nobody looked into", "EXECUTION_GAP", "HIGH", 25.0),
    ("GAP-03", "1.0.0", "Look at an alert too quick to be a review", "EXECUTION_GAP", "MEDIUM", 15.0),
    ("GAP-04", "1.0.0", "Same trouble keeps returning to an asset", "EXECUTION_GAP", "HIGH", 20.0),
    ("GAP-05", "1.0.0", "Outcome at odds with how grave the alert was", "EXECUTION_GAP", "HIGH", 20.0),
    ("GAP-06", "1.0.0", "Workflow skips the step up it owes", "EXECUTION_GAP", "CRITICAL", 30.0),
    ("NEG-01", "1.0.0", "Key asset has gone quiet", "NEGATIVE_SPACE", "CRITICAL", 25.0),
    ("NEG-02", "1.0.0", "Alert volume of an entity drops away", "NEGATIVE_SPACE", "HIGH", 20.0),
    ("PEER-01", "1.0.0", "Escalates much less than comparable entities", "PEER_DEVIATION", "HIGH", 20.0),
]

# --- fixed values: other vocabularies and formats ---------------------------------------
MANDATORY_ESCALATION_CATEGORIES = ["EXFILTRATION_SUSPICION", "RANSOMWARE", "DATA_EXFIL"]
RANSOM_CATEGORIES = ["RANSOMWARE", "DATA_EXFIL"]
CVE_PATTERN = r"^CVE-\d{4}-\d{4,7}$"
TECHNIQUE_PATTERN = r"^T\d{4}(\.\d{3})?$"
GENESIS_HASH = "0" * 64
PLACEHOLDERS = ["N/A", "NA", "TODO", "UNKNOWN", "NONE", "NULL", "PLACEHOLDER", ""]
T_CRITICAL_95 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571,
                 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228}
EXPECTED_WORKFLOW = ["Alert", "Investigation", "Escalation", "Case", "Closure"]
FINDING_STATES = ["FAIL", "CONFIRMED"]


@dataclass(frozen=True)
class Expectation:
    """One row of the expected-evidence matrix; None means "any"."""

    name: str
    category: str | None = None
    asset_type: str | None = None
    criticality: str | None = None
    sector: str | None = None
    size_tier: str | None = None
    window_hours: float = 48.0
    applicable: bool = True


DEFAULT_EXPECTATIONS = (
    Expectation("CRITICAL_ASSET_TELEMETRY_EXPECTATION", criticality="CRITICAL", window_hours=48.0),
    Expectation("EXPECT_MALWARE_DETECTION", category="MALWARE_DETECTION", window_hours=720.0),
    Expectation("EXPECT_AUTHENTICATION_FAILURE", category="AUTHENTICATION_FAILURE", window_hours=720.0),
    Expectation("EXPECT_PRIVILEGE_ESCALATION", category="PRIVILEGE_ESCALATION", window_hours=720.0),
    Expectation("EXPECT_EXFILTRATION_SUSPICION", category="EXFILTRATION_SUSPICION", window_hours=720.0),
)


@dataclass(frozen=True)
class RuleParams:
    """Thresholds of the detection rules."""

    min_completeness: float = 50.0
    hasty_seconds: int = 15
    peer_median_seconds: float = 450.0
    case_window_seconds: int = 86400
    repeat_window_seconds: int = 7 * 86400
    repeat_limit: int = 5
    baseline_days: int = 30
    drop_pct: float = 70.0
    drop_z: float = 1.5
    density_ratio: float = 0.20
    maintenance_silence_hours: float = 24.0
    default_silence_hours: float = 48.0
    escalation_rate_sigmas: float = 2.0
    strict_maintenance_overlap: bool = False
    expectations: tuple[Expectation, ...] = DEFAULT_EXPECTATIONS


@dataclass(frozen=True)
class RiskParams:
    """Component caps and the confidence policy of the entity risk score."""

    caps: dict = field(default_factory=lambda: {
        "execution_gap": 30.0, "negative_space": 25.0, "peer_deviation": 20.0,
        "investigation_anomaly": 15.0, "asset_criticality": 10.0})
    low_confidence: float = 0.70
    confidence_floor: float = 0.50
    explanation_refs: int = 10


@dataclass(frozen=True)
class QueueParams:
    """Factor weights and the diversity limits of the review queue."""

    weights: dict = field(default_factory=lambda: {
        "risk_significance": 0.25, "finding_severity": 0.20, "asset_criticality": 0.15,
        "evidence_completeness": 0.15, "evidence_confidence": 0.10, "novelty": 0.05,
        "peer_deviation": 0.05, "review_urgency": 0.05})
    max_per_entity: int = 2
    max_per_category: int = 3
    target_size: int = 10
    low_completeness: float = 40.0
    low_completeness_penalty: float = 15.0


RULES = RuleParams()
RISK = RiskParams()
QUEUE = QueueParams()
