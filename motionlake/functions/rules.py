"""Header names, metric names and keyword rules of the jump and sprint files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# vendor header -> standard header; two sources of one target are coalesced in this order
VENDOR_HEADERS = {
    "Name": "ATHLETE_NAME",
    "ExternalId": "ATHLETE_ID",
    "Test Type": "TEST_TYPE",
    "Date": "TEST_DATE",
    "Time": "TEST_TIME",
    "BW [KG]": "BODY_WEIGHT_KG",
    "Additional Load [kg]": "ADDITIONAL_LOAD_KG",
    "TestId": "TEST_ID",
    "Segment": "SEGMENT",
    "Position": "POSITION",
    "Type": "TEST_TYPE",
    "Excluded": "EXCLUDED",
    "Tags": "TAGS",
    "System Weight": "BODY_WEIGHT_KG",
}

# headers that mark the two layouts
LONG_HEADERS = {"TARGET_VARIABLE", "RESULT", "ATHLETE_NAME", "TEST_DATE"}
WIDE_ID_HEADERS = {
    "Name", "TestId", "Date", "Time", "Segment", "Position", "Type", "Excluded", "Tags", "System Weight",
    "ExternalId",
}
WIDE_METRIC_HEADERS = {
    "Jump Height", "Braking RFD", "Stiffness", "Peak Braking Force", "Peak Propulsive Force", "Flight Time",
    "Takeoff Velocity", "Peak Velocity", "RSI", "mRSI", "Countermovement Depth", "Jump Momentum",
    "Braking Phase", "Propulsive Phase",
}

# columns of a wide file kept as identifiers
ID_HEADERS = {
    "ATHLETE_NAME", "ATHLETE_ID", "TEST_TYPE", "TEST_DATE", "TEST_TIME", "BODY_WEIGHT_KG", "ADDITIONAL_LOAD_KG",
    "Reps", "Tags", "TAGS", "TEST_ID", "SEGMENT", "POSITION", "EXCLUDED", "TestId", "Date", "Time", "Name",
    "Segment", "Position", "Type", "Excluded", "System Weight",
}

# a header holding one of these (any case) is a metric, and so is one holding a metric symbol
METRIC_SYMBOLS = "[/%|"
METRIC_KEYWORDS = {
    "force", "power", "velocity", "time", "height", "impulse", "rfd", "depth", "duration", "peak", "mean", "avg",
    "average", "concentric", "eccentric", "jump", "rsi", "takeoff", "landing", "contraction", "flight", "braking",
    "countermovement", "propulsive", "stiffness", "displacement", "relative", "momentum", "unweighting", "phase",
    "net", "positive", "ratio", "index", "stabilization", "performance", "left", "right", "l|r", "asymmetry",
    "asym", "mrsi", "modified",
}

# whole metric names with a canonical spelling
METRIC_SPELLINGS = {
    "Peak Power / BM": "Peak Power Per BM",
    "Flight Time:Contraction Time": "Flight Time To Contraction Time Ratio",
    "RSI-modified": "RSI Modified",
    "% (Asym)": "Asymmetry",
    "Imp-Mom": "Impulse Momentum",
    "RFD": "Rate of Force Development",
}

REQUIRED_LONG = {"ATHLETE_NAME", "TARGET_VARIABLE", "RESULT", "TEST_DATE", "LIMB"}

# test kinds looked for in metric names, first match wins
TEST_KINDS = ["CMJ", "SJ", "DJ", "JUMP"]
ALL_TESTS = "All Jumps"


@dataclass(frozen=True)
class Rule:
    """Substring rule on a metric name; an empty ``include`` accepts every name."""

    label: str
    include: tuple[str, ...]
    exclude: tuple[str, ...] = ()
    exclude_as_written: tuple[str, ...] = ()

    def matches(self, metric: Column) -> Column:
        upper = F.upper(metric)
        found = F.lit(not self.include)
        for text in self.include:
            found = found | upper.contains(text)
        for text in self.exclude:
            found = found & ~upper.contains(text)
        for text in self.exclude_as_written:
            found = found & ~metric.contains(text)
        return F.coalesce(found & metric.isNotNull(), F.lit(False))


CATEGORIES = [
    Rule("power", ("POWER",)),
    Rule("force", ("FORCE",), ("RFD",)),
    Rule("velocity", ("VELOCITY", "TAKEOFF")),
    Rule("jump", ("JUMP", "HEIGHT", "RSI", "MRSI", "MOMENTUM")),
    Rule("timing", ("TIME", "DURATION", "PHASE")),
    Rule("rfd", ("RFD",)),
    Rule("impulse", ("IMPULSE",)),
    Rule("stiffness", ("STIFFNESS", "DISPLACEMENT", "DEPTH")),
    Rule("landing", ("LANDING", "STABILIZATION")),
    Rule("asymmetry", ("L|R", "LEFT", "RIGHT", "ASYM", "INDEX")),
    Rule("braking", ("BRAKING",), ("RFD",)),
    Rule("propulsive", ("PROPULSIVE",)),
]

FAMILIES = [
    Rule(
        "All Performance Metrics",
        (),
        exclude_as_written=("RESULT_TYPE", "START_OF_MOVEMENT_THRESHOLD", "START_OF_INTEGRATION"),
    ),
    Rule("Force Production", ("FORCE", "WEIGHT_RELATIVE", "BODYMASS_RELATIVE", "BM_REL"), ("RFD", "RPD")),
    Rule("Power Output", ("POWER", "VELOCITY_AT_PEAK_POWER")),
    Rule("Speed/Velocity", ("VELOCITY", "ACCELERATION"), ("POWER",)),
    Rule("Jump Mechanics", ("JUMP_HEIGHT", "FLIGHT_TIME", "RSI", "STIFFNESS", "DISPLACEMENT")),
    Rule("Rate of Force Development", ("RFD", "RPD")),
    Rule("Impulse & Momentum", ("IMPULSE", "MOMENTUM")),
    Rule("Timing & Phases", ("TIME", "DURATION", "PHASE", "BEGIN_", "CONTRACTION")),
    Rule(
        "Ratios & Performance Indices",
        ("RATIO", "RELATIVE", "INDEX", "_REL_", "MODIFIED"),
        ("FORCE", "POWER", "VELOCITY", "IMPULSE"),
    ),
]

PRESETS = {
    "All": (),
    "Power & Force": ("POWER", "FORCE"),
    "Speed & Velocity": ("VELOCITY", "SPEED", "TAKEOFF"),
    "Jump Performance": ("JUMP", "HEIGHT", "RSI", "FLIGHT"),
    "Timing": ("TIME", "DURATION", "PHASE"),
    "RFD": ("RFD", "RPD"),
    "Asymmetry": ("ASYM", "L|R", "LEFT", "RIGHT"),
}

# keyword of a leading metric -> word used in a cluster's name, first match wins
CLUSTER_WORDS = [
    (("POWER",), "Power"),
    (("FORCE",), "Force"),
    (("VELOCITY", "SPEED"), "Speed"),
    (("JUMP", "HEIGHT"), "Jump"),
    (("RFD",), "RFD"),
]
