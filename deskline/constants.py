"""Fixed values.

FIXED VALUES -- these must equal the service-desk system's rules for the results to be right.
They are stated plainly, in natural order; every operator also takes them as parameters.
"""

# --- ticket scoring -------------------------------------------------------------------------
# priority weight, anything else 0
PRIORITY_WEIGHTS = {1: 5, 2: 4, 3: 3, 4: 2, 5: 1}
PRIORITY_DEFAULT_WEIGHT = 0

# status weight, anything else 10
STATUS_WEIGHTS = {
    1: 50, 5: -10, 7: -20, 11: 70, 21: 60, 24: 65, 28: 55, 29: 60, 32: 0,
    36: 65, 38: -400, 41: -20, 54: 60, 56: 60, 64: -20, 70: 70, 71: 70, 74: -20,
}
STATUS_DEFAULT_WEIGHT = 10

SLA_MISS_PENALTY = 100  # points per SLA pair not met
AGE_POINTS_PER_DAY = 10  # points per whole day since creation

# (met column, due column, display name), in display order
SLA_PAIRS = [
    ("firstResponseDateTime", "firstResponseDueDateTime", "First Response"),
    ("resolutionPlanDateTime", "resolutionPlanDueDateTime", "Resolution Plan"),
    ("resolvedDateTime", "resolvedDueDateTime", "Resolution"),
]

# priority -> (label, colour); anything else ("Unknown", "default")
PRIORITY_LABELS = {
    4: ("Critical", "attention"),
    1: ("High", "warning"),
    2: ("Medium", "default"),
    3: ("Low", "default"),
    5: ("Very Low", "default"),
}

# status -> label; anything else "Status ID <n>"
STATUS_LABELS = {
    1: "New",
    5: "Completed",
    7: "Waiting Client",
    11: "Escalated",
    21: "Working Issue Now",
    24: "Client Responded",
    28: "Quote Needed",
    29: "Reopened",
    32: "Scheduled",
    36: "Scheduling Needed",
    38: "Waiting on Hold",
    41: "Waiting Vendor",
    54: "Needs Project",
    56: "Received in Full",
    64: "Scheduled Next NA",
    70: "Assigned",
    71: "Schedule Onsite",
    74: "Scheduled Onsite",
}

EXCLUDED_QUEUES = [29683506, 29683552, 29683546, 29683535]
CLOSED_STATUS = 5
DISPLAY_ZONE = "America/Chicago"
SHORT_DESCRIPTION_LIMIT = 200

# --- KPIs -------------------------------------------------------------------------------------
KPI_QUEUES = [8, 29683537, 29683539, 29683540, 29683555]
AGING_DAYS = 5
AGING_EXCLUDED_STATUS = [7, 69, 5, 41]
UTILIZATION_BASE_HOURS = 40.0
SUPPORT_CALL_DIRECTION = "Inbound"
SUPPORT_CALL_CATEGORY = "Support"
REACTIVE_TICKET_CATEGORY = "Support Desk"
ROLLING_DAYS = 30

# (name, category, type) of every KPI
KPI_DEFINITIONS = [
    ("SLA Met", "Service Desk", "Team"),
    ("Aging Tickets", "Service Desk", "Team"),
    ("Avg Response Time", "Service Desk", "Team"),
    ("Avg Resolution Time", "Service Desk", "Team"),
    ("# of Support Calls", "Service Desk", "Team"),
    ("CSAT Rolling 30", "Service Desk", "Team"),
    ("Endpoints Patched", "Field Team", "Team"),
    ("Uptime Rolling 30 Days", "Field Team", "Team"),
    ("Reactive Ticket per Endpoint", "Field Team", "Team"),
    ("Utilization", "Resource", "Individual"),
    ("Avg Response Time", "Resource", "Individual"),
    ("Avg Resolution Time", "Resource", "Individual"),
]

# --- devices ----------------------------------------------------------------------------------
INTEGRATIONS = ["Datto_RMM", "Huntress", "Workstation_AD", "Server_AD", "ImmyBot", "Auvik", "CyberCNS", "ITGlue"]
FULL_MATCH_SETS = [
    ["Datto_RMM", "Huntress", "Workstation_AD", "ImmyBot", "CyberCNS", "ITGlue"],
    ["Datto_RMM", "Huntress", "Server_AD", "ImmyBot", "CyberCNS", "ITGlue"],
]
ISSUE_TYPES = [
    "no_antivirus_installed",
    "missing_defender_on_workstation",
    "missing_sentinel_one_on_server",
    "not_seen_recently",
    "reboot_required",
    "expired_warranty",
]
UNNAMED_DEVICE = "Unnamed Device"

# --- documents --------------------------------------------------------------------------------
CHUNK_MAX_CHARS = 6000
ANSWER_MAX_TOKENS = 800
REQUIREMENT_CATEGORIES = ["permitted", "prohibited", "coverage_condition"]
DEFAULT_REQUIREMENT_CATEGORY = "general"

# --- commands ---------------------------------------------------------------------------------
COMMAND_PREFIXES = ["askbot", "getnextticket", "mytickets", "reviewinsurance"]
PDF_CONTENT_TYPE = "application/pdf"
NO_RESPONSE = "No response received."
