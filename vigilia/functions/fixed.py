"""Fixed values that results depend on: names of operations, thresholds, weights."""

from __future__ import annotations

# Action categories of operations. Where sets share a name, the first category listed wins.
ACTION_CATEGORIES = {
    "DefenseEvasion": ["StopLogging", "DeleteTrail", "PutEventSelectors", "DisableSecurityHub", "DeleteDetector", "UpdateDetector", "PutBucketLogging"],
    "PermissionChange": [
        "AttachUserPolicy", "AttachRolePolicy", "PutUserPolicy", "PutRolePolicy", "CreatePolicy", "CreatePolicyVersion", "SetDefaultPolicyVersion",
        "AddUserToGroup", "UpdateAssumeRolePolicy", "PutBucketPolicy", "PutBucketAcl", "PutKeyPolicy", "CreateGrant", "DeleteBucketPolicy",
    ],
    "CredentialAccess": ["CreateAccessKey", "UpdateAccessKey", "GetSecretValue", "Decrypt", "GetParameter"],
    "Persistence": ["CreateUser", "CreateAccessKey", "CreateLoginProfile", "UpdateAssumeRolePolicy", "CreatePolicyVersion", "SetDefaultPolicyVersion", "AttachUserPolicy", "AttachRolePolicy"],
    "DataAccess": [
        "GetObject", "GetSecretValue", "Decrypt", "GetParameter", "BatchGetItem", "Scan", "Query", "CopyObject", "RestoreObject", "PutObject", "CompleteMultipartUpload",
    ],
    "NetworkChange": ["AuthorizeSecurityGroupIngress", "AuthorizeSecurityGroupEgress", "RevokeSecurityGroupIngress", "CreateSecurityGroup", "ModifyVpcAttribute", "CreateVpc", "DeleteVpc"],
    "ComputeChange": ["StartInstances", "StopInstances", "RunInstances", "TerminateInstances", "ModifyInstanceAttribute"],
    "StorageChange": ["CreateSnapshot", "ModifySnapshotAttribute", "DeleteObject"],
    "Discovery": [
        "ListBuckets", "ListUsers", "ListRoles", "ListPolicies", "DescribeInstances", "DescribeSecurityGroups", "DescribeSnapshots", "DescribeVolumes",
        "GetCallerIdentity", "GetBucketPolicy", "GetAccountAuthorizationDetails", "ListAccessKeys", "ListObjects", "HeadObject",
    ],
    "Auth": ["ConsoleLogin", "AssumeRole", "AssumeRoleWithSAML", "GetSessionToken"],
}
OTHER_CATEGORY = "Other"

SENSITIVE_ACTIONS = [
    "CreateAccessKey", "AttachRolePolicy", "AttachUserPolicy", "PutBucketPolicy", "PutBucketAcl", "PutKeyPolicy", "StopLogging", "DeleteTrail",
    "GetSecretValue", "Decrypt", "UpdateAssumeRolePolicy", "CreateGrant", "CreateUser", "DeleteBucketPolicy",
]

SERVICE_OPERATIONS = {
    "s3.amazonaws.com": [
        "GetObject", "PutObject", "HeadObject", "ListObjects", "ListBuckets", "GetBucketPolicy", "PutBucketPolicy", "PutBucketAcl", "DeleteBucketPolicy",
        "CopyObject", "RestoreObject", "CompleteMultipartUpload", "DeleteObject",
    ],
    "ec2.amazonaws.com": [
        "DescribeInstances", "DescribeSecurityGroups", "DescribeVolumes", "DescribeSnapshots", "StartInstances", "StopInstances", "RunInstances",
        "TerminateInstances", "CreateSnapshot", "ModifySnapshotAttribute", "AuthorizeSecurityGroupIngress",
    ],
    "iam.amazonaws.com": [
        "ListUsers", "ListRoles", "ListPolicies", "CreateUser", "CreateAccessKey", "UpdateAccessKey", "AttachUserPolicy", "AttachRolePolicy", "PutUserPolicy",
        "PutRolePolicy", "CreatePolicy", "CreatePolicyVersion", "SetDefaultPolicyVersion", "AddUserToGroup", "UpdateAssumeRolePolicy", "CreateLoginProfile",
        "ListAccessKeys", "GetAccountAuthorizationDetails",
    ],
    "sts.amazonaws.com": ["AssumeRole", "AssumeRoleWithSAML", "GetSessionToken", "GetCallerIdentity"],
    "kms.amazonaws.com": ["Decrypt", "CreateGrant", "PutKeyPolicy"],
    "secretsmanager.amazonaws.com": ["GetSecretValue"],
    "ssm.amazonaws.com": ["GetParameter"],
    "cloudtrail.amazonaws.com": ["StopLogging", "DeleteTrail", "PutEventSelectors"],
}
# Names under which access logs report a read of an object.
GETOBJECT_OPERATIONS = ["REST.GET.OBJECT"]

# Verb prefixes (lower case) of the create / read / update / delete class.
CRUD_PREFIXES = {
    1: ["create", "put", "run", "attach", "add", "register"],
    2: ["describe", "get", "list", "lookup", "head"],
    3: ["update", "modify", "set"],
    4: ["delete", "remove", "terminate", "deactivate", "stop"],
}
CRUD_UNKNOWN, CRUD_OTHER = 0, 99

IP_PATTERN = r"^\d{1,3}(\.\d{1,3}){3}$|^[0-9A-Fa-f:]+:[0-9A-Fa-f:]*$"
INSTANCE_ID_PATTERN = r"^i-[0-9a-f]{8}([0-9a-f]{9})?$"
SYSTEM_ROLES = [
    "AWSServiceRoleForAutoScaling", "splunk_lambda", "config-role-us-west-1", "flowlogsRole", "AWSServiceRoleForAmazonGuardDuty",
    "AWS_InspectorEvents_Invoke_Assessment_Template", "AWSServiceRoleForAmazonInspector",
]
SYSTEM_ROLE_PREFIXES = ["AWSServiceRoleFor", "AWS_"]
SYSTEM_ROLE_PARTS = ["lambda", "config-role", "flowlogsRole", "Inspector"]

# Words (lower case) that stand for a missing value.
PLACEHOLDERS = ["unknown", "unknown_account", "unknown_principal", "unknown_src", "unknown_src_uid", "unknown_interface", "unknown_destination", "nan", "none", "null"]

# Paths of a field, tried in this order.
FIELD_PATHS = {
    "time": ["time", "start_time", "event_time", "metadata.event_time"],
    "account": ["cloud.account.uid", "cloud.account.account_id", "cloud.account.name"],
    "principal": ["actor.user.uid", "actor.user.name", "actor.session.uid", "actor.user.account.uid", "user.uid", "user.name"],
    "src_ip": ["src_endpoint.ip", "src_endpoint.ip_addr"],
    "src_uid": ["src_endpoint.uid", "src_endpoint.instance_uid", "src_endpoint.instance.uid", "src_endpoint.hostname", "src_endpoint.name"],
    "interface_uid": ["src_endpoint.interface_uid", "network_interface.uid", "network_interface.interface_uid", "interface.uid", "interface_uid"],
    "dst_ip": ["dst_endpoint.ip", "dst_endpoint.ip_addr"],
    "dst_port": ["dst_endpoint.port", "dst_port", "network.dst_port"],
    "protocol": ["connection_info.protocol_name", "protocol_name", "network.protocol", "traffic.protocol_name"],
    "dst_domain": ["dst_endpoint.domain", "dst_endpoint.hostname", "dst_endpoint.name", "url.domain", "http_request.url.hostname"],
    "bytes_out": ["traffic.bytes_out", "traffic.bytes", "bytes_out", "network.bytes_out"],
    "bytes_in": ["traffic.bytes_in", "bytes_in", "network.bytes_in"],
    "api_operation": ["api.operation", "api.operation_name", "activity_name", "operation"],
    "api_service": ["api.service.name", "cloud.service.name", "service.name"],
    "user_agent": ["http_request.user_agent", "user_agent", "src_endpoint.user_agent"],
    "resource": ["resource.name", "object.name", "bucket.name"],
}

# Sessions.
GAP_MINUTES = 30
BURST_SECONDS = 300
SINGLE_EVENT_MINUTES = 1e-6
NGRAM_KEEP, SEQUENCE_KEEP, TOP_SESSIONS = 200, 15, 50
CATEGORY_CHAINS = [
    ("Discovery", "PermissionChange"), ("Discovery", "CredentialAccess"), ("Discovery", "DataAccess"), ("PermissionChange", "CredentialAccess"), ("PermissionChange", "DataAccess"),
]
CATEGORY_TRIPLES = [("Auth", "Discovery", "DataAccess"), ("Auth", "Discovery", "PermissionChange")]
EVENT_PAIRS = [
    ("GetBucketPolicy", "PutBucketPolicy"), ("ListRoles", "AssumeRole"), ("CreateAccessKey", "GetObject"), ("StopLogging", "GetObject"),
    ("DeleteTrail", "GetObject"), ("PutBucketPolicy", "GetObject"), ("PutBucketAcl", "GetObject"),
]
DISTRIBUTION_FEATURES = [
    "num_events", "duration_minutes", "events_per_minute", "unique_services", "num_getobject_events", "num_sensitive_actions", "failed_event_ratio", "max_events_in_5min",
]
DEVIATION_FEATURES = ["num_events", "duration_minutes", "unique_services", "num_getobject_events", "num_sensitive_actions", "failed_event_ratio"]
SESSION_HIGH, SESSION_MEDIUM = 70, 35
SENSITIVE_WEIGHTS = [("permission_change", "PermissionChange", 3.0), ("credential_access", "CredentialAccess", 3.0), ("persistence", "Persistence", 2.0), ("defense_evasion", "DefenseEvasion", 3.0)]

# Behaviour scores of actors.
CT_WEIGHTS = {"d_op": 0.25, "d_resource": 0.20, "d_region": 0.20, "d_volume": 0.15, "d_ip": 0.10, "d_hour": 0.10}
BYTES_CEILING = 1e12

# Exfiltration.
SMALL_TRANSFER = 20 * 1024 * 1024
MIN_TOTAL_BYTES = 100 * 1024 * 1024
MIN_EVENTS, MIN_HOURS, MIN_SMALL_RATIO = 20, 6, 0.80
REGULAR_CV, JITTERED_CV, BAND, MIN_BAND_RATIO, MIN_INTERVALS = 0.25, 0.35, 0.35, 0.80, 10
NETWORK_MAX, TIME_MAX = 170, 155
SUSTAINED_RATIO, SPIKE_RATIO, RAMP_FINAL, RAMP_SLOPE = 2.5, 4.0, 3.0, 0.12
SUSTAINED_DAYS, SPIKE_DAYS, CUMULATIVE_RATIO = 7, 4, 2.0
UEBA_ALERT, EXFIL_ALERT, SESSION_ALERT = 0.40, 40, 40


def category_map() -> dict[str, str]:
    """Operation to category, the first category listed winning."""
    out: dict[str, str] = {}
    for category, names in ACTION_CATEGORIES.items():
        for name in names:
            out.setdefault(name, category)
    return out


def service_map() -> dict[str, str]:
    return {name: service for service, names in SERVICE_OPERATIONS.items() for name in names}
