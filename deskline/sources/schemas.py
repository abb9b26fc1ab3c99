"""Explicit schemas for the JSON feeds and the stored tables (no inference on read)."""

from __future__ import annotations

from pyspark.sql import types as T

UDF_ITEM = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])

_TICKET_STAMPS = ["createDate", "dueDateTime", "firstResponseDateTime", "firstResponseDueDateTime",
                  "resolutionPlanDateTime", "resolutionPlanDueDateTime", "resolvedDateTime", "resolvedDueDateTime",
                  "completedDate", "lastActivityDate"]

# Feed schema: stamps arrive as text and are parsed with B1 after the read.
TICKET_FEED = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("ticketNumber", T.StringType()),
     T.StructField("title", T.StringType()), T.StructField("description", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ["companyID", "contactID", "contractID", "assignedResourceID", "queueID"]]
    + [T.StructField(c, T.IntegerType()) for c in ["status", "priority", "ticketCategory", "ticketType", "issueType",
                                                    "subIssueType", "source"]]
    + [T.StructField("serviceLevelAgreementHasBeenMet", T.BooleanType()), T.StructField("category", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in _TICKET_STAMPS]
    + [T.StructField("userDefinedFields", T.ArrayType(UDF_ITEM))]
)
TICKET_STAMPS = _TICKET_STAMPS

DEVICE_STRINGS = ["Name", "device_name", "LastLoggedOnUser", "IPv4Address", "OperatingSystem", "antivirusProduct",
                  "antivirusStatus", "lastReboot", "lastSeen", "patchStatus", "warrantyDate"]
DEVICE_IDS = ["datto_id", "huntress_id", "immy_id", "auvik_id", "cybercns_id", "itglue_id", "manufacturer_name",
              "device_model_name", "serial_number"]
DEVICE_FLAGS = ["Datto_RMM", "Huntress", "Workstation_AD", "Server_AD", "ImmyBot", "Auvik", "ITGlue", "CyberCNS",
                "Inactive_Computer"]
# Feed schema: flags and ids are read as text so 'Yes'/true/7/"7" all survive the read.
DEVICE_FEED = T.StructType(
    [T.StructField(c, T.StringType()) for c in DEVICE_STRINGS + ["rebootRequired"] + DEVICE_IDS + DEVICE_FLAGS])

CONTRACT_UNIT_COLS = ["id", "contractID", "serviceID", "startDate", "endDate", "approveAndPostDate", "unitCost",
                      "unitPrice", "internalCurrencyPrice", "organizationalLevelAssociationID", "invoiceDescription",
                      "units"]
CONTRACT_UNIT_FEED = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("contractID", T.LongType()), T.StructField("serviceID", T.LongType()),
    T.StructField("startDate", T.StringType()), T.StructField("endDate", T.StringType()),
    T.StructField("approveAndPostDate", T.StringType()),
    T.StructField("unitCost", T.DoubleType()), T.StructField("unitPrice", T.DoubleType()),
    T.StructField("internalCurrencyPrice", T.DoubleType()),
    T.StructField("organizationalLevelAssociationID", T.LongType()),
    T.StructField("invoiceDescription", T.StringType()), T.StructField("units", T.DoubleType()),
])

TIME_ENTRY_COLS = ["id", "contractID", "contractServiceBundleID", "contractServiceID", "createDateTime", "creatorUserID",
                   "dateWorked", "endDateTime", "hoursToBill", "hoursWorked", "internalNotes", "isNonBillable",
                   "lastModifiedDateTime", "resourceID", "roleID", "startDateTime", "summaryNotes", "taskID",
                   "ticketID", "timeEntryType"]
TIME_ENTRY_STAMPS = ["createDateTime", "dateWorked", "endDateTime", "lastModifiedDateTime", "startDateTime"]
TIME_ENTRY_FEED = T.StructType(
    [T.StructField(c, T.LongType()) for c in ["id", "contractID", "contractServiceBundleID", "contractServiceID"]]
    + [T.StructField("createDateTime", T.StringType()), T.StructField("creatorUserID", T.LongType()),
       T.StructField("dateWorked", T.StringType()), T.StructField("endDateTime", T.StringType()),
       T.StructField("hoursToBill", T.DoubleType()), T.StructField("hoursWorked", T.DoubleType()),
       T.StructField("internalNotes", T.StringType()), T.StructField("isNonBillable", T.BooleanType()),
       T.StructField("lastModifiedDateTime", T.StringType()), T.StructField("resourceID", T.LongType()),
       T.StructField("roleID", T.LongType()), T.StructField("startDateTime", T.StringType()),
       T.StructField("summaryNotes", T.StringType()), T.StructField("taskID", T.LongType()),
       T.StructField("ticketID", T.LongType()), T.StructField("timeEntryType", T.IntegerType()),
       T.StructField("userDefinedFields", T.ArrayType(UDF_ITEM))]
)

# Contracts: all 36 fields with their types.
_CONTRACT_FIELDS = [
    ("id", T.LongType()), ("status", T.IntegerType()), ("startDate", T.StringType()), ("endDate", T.StringType()),
    ("lastModifiedDateTime", T.StringType()), ("companyID", T.LongType()), ("contactID", T.LongType()),
    ("contractName", T.StringType()), ("contractNumber", T.StringType()), ("contractType", T.IntegerType()),
    ("contractCategory", T.IntegerType()), ("contractPeriodType", T.IntegerType()), ("billingPreference", T.IntegerType()),
    ("isCompliant", T.BooleanType()), ("isDefaultContract", T.BooleanType()), ("setupFee", T.DoubleType()),
    ("estimatedCost", T.DoubleType()), ("estimatedHours", T.DoubleType()), ("estimatedRevenue", T.DoubleType()),
    ("overageBillingRate", T.DoubleType()), ("description", T.StringType()), ("purchaseOrderNumber", T.StringType()),
    ("opportunityID", T.LongType()), ("billToCompanyID", T.LongType()), ("billToCompanyContactID", T.LongType()),
    ("renewedContractID", T.LongType()), ("exclusionContractID", T.LongType()), ("setupFeeBillingCodeID", T.LongType()),
    ("contractExclusionSetID", T.LongType()), ("serviceLevelAgreementID", T.LongType()),
    ("internalCurrencySetupFee", T.DoubleType()), ("organizationalLevelAssociationID", T.LongType()),
    ("internalCurrencyOverageBillingRate", T.DoubleType()), ("contactName", T.StringType()),
    ("timeReportingRequiresStartAndStopTimes", T.IntegerType()), ("userDefinedFields", T.ArrayType(UDF_ITEM)),
]
CONTRACT_FEED = T.StructType([T.StructField(n, t) for n, t in _CONTRACT_FIELDS])
CONTRACT_COLS = [n for n, _ in _CONTRACT_FIELDS]
