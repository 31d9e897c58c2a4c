"""Shapes the operators need, derived from the given tables.

Each text is one SELECT in the dialect Spark and DuckDB share; ``$name`` stands
for a table.  Small vocabularies are inline VALUES, joined on a key, so the
rows, and the work, grow with the tables.
"""

from __future__ import annotations

from hushframe import rules


def _values(rows: list[tuple]) -> str:
    def literal(value: object) -> str:
        if isinstance(value, bool):
            return "true" if value else "false"
        if isinstance(value, str):
            return "'" + value.replace("'", "''") + "'"
        return str(value)

    return ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)


def _whole(a: str, b: int) -> str:
    """Integer quotient in both dialects."""
    return f"CAST(floor({a} / {b}) AS BIGINT)"


def _text(a: str) -> str:
    return f"CAST({a} AS STRING)"


# ---------------------------------------------------------------- event rows
_V4 = (
    f"{_text('1 + user_id % 223')} || '.' || {_text('event_id % 256')} || '.' || "
    f"{_text(_whole('event_id', 256) + ' % 256')} || '.' || {_text('1 + event_id % 254')}"
)
_USER = _text("user_id")

#: Login-shaped event rows with every kind of address, name and URL.
EVENTS = f"""
SELECT event_id, ts, value,
  {_text('CAST(ts AS DATE)')} AS log_date,
  event_type AS EVENT_TYPE,
  {_text('CAST(ts AS DATE)')} || 'T00:00:00.000Z' AS TIMESTAMP_DERIVED,
  'R' || {_text(_whole('event_id', 3))} AS REQUEST_ID,
  '005' || lpad({_USER}, 6, '0') AS USER_ID,
  CASE WHEN event_id % 40 = 3 THEN '   '
       WHEN event_id % 4 = 0 THEN '  User' || {_USER} || '@Example.com '
       WHEN event_id % 4 = 2 THEN 'USER' || {_USER} || '@EXAMPLE.COM'
       ELSE 'user' || {_USER} || '@example.com' END AS USER_NAME,
  CASE event_id % 10
       WHEN 0 THEN {_V4} || ':443'
       WHEN 1 THEN '2001:db8:' || {_text('event_id % 9999')} || ':1:2:3:4:5'
       WHEN 2 THEN 'fe80::' || {_text('event_id % 9999')}
       WHEN 3 THEN ''
       WHEN 4 THEN 'host-' || {_USER}
       WHEN 5 THEN ' ' || {_V4} || ' '
       WHEN 6 THEN '::1'
       WHEN 7 THEN 'a.b.c.d'
       ELSE {_V4} END AS CLIENT_IP,
  CASE WHEN event_id % 3 = 0 THEN {_V4} ELSE '' END AS FORWARDED_FOR_IP,
  CASE event_id % 5
       WHEN 0 THEN '/' || event_type || '?k=' || props
       WHEN 1 THEN 'https://' || {_V4} || '/' || event_type || ';jsessionid=' || {_USER}
       WHEN 2 THEN ' /p/' || event_type || '#top?x '
       WHEN 3 THEN 'http://app.example.com/ipinfo/' || {_V4} || '/info?x=1'
       ELSE '/' || event_type || '/v1.2.3.4.5' END AS URI,
  'S' || {_USER} || '-' || {_text('CAST(ts AS DATE)')} AS SESSION_KEY,
  CASE user_id % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' ELSE 'DE' END AS COUNTRY_CODE,
  props AS QUERY,
  {_whole('value * 10', 1)} AS RUN_TIME
FROM $events
"""
EVENT_HEADER = (
    "EVENT_TYPE", "TIMESTAMP_DERIVED", "REQUEST_ID", "USER_ID", "USER_NAME", "CLIENT_IP",
    "URI", "SESSION_KEY", "COUNTRY_CODE", "QUERY", "RUN_TIME",
)

#: One header record per day and event type, as the log service lists its files.
HEADERS = f"""
SELECT '0AT' || {_text('CAST(ts AS DATE)')} || event_type AS Id,
  CASE event_type WHEN 'view' THEN 'Login' WHEN 'click' THEN 'SearchClick' WHEN 'purchase' THEN 'ReportExport'
       WHEN 'signup' THEN 'API' ELSE 'ApexCallout' END AS EventType,
  {_text('CAST(ts AS DATE)')} || 'T00:00:00.000+0000' AS LogDate,
  CAST(CAST(ts AS DATE) AS TIMESTAMP) AS log_ts,
  '61.0' AS ApiVersion,
  CASE event_type
       WHEN 'view' THEN 'EVENT_TYPE, USER_ID,USER_NAME ,CLIENT_IP,,URI,SESSION_KEY,COUNTRY_CODE'
       WHEN 'click' THEN 'EVENT_TYPE,QUERY_ID,CLICKED_RECORD_ID,RANK,SEARCH_QUERY,'
       WHEN 'purchase' THEN 'EVENT_TYPE,USER_ID,REPORT_ID,QUERY,DEVICE_ID'
       WHEN 'signup' THEN 'EVENT_TYPE,API_RESOURCE,HTTP_HEADERS,LOGIN_KEY,ACCESS_TOKEN_HINT,' || 'QUERY'
       ELSE 'EVENT_TYPE,URL,EXCEPTION_MESSAGE,LOGIN_URL,RUN_TIME,USER_ID' END AS LogFileFieldNames,
  CASE WHEN extract(day FROM min(ts)) % 5 = 0 THEN 'Hourly' ELSE 'Daily' END AS Interval,
  count(*) AS n_rows, sum(length(props)) AS LogFileLength
FROM $events GROUP BY CAST(ts AS DATE), event_type
"""

# ---------------------------------------------------------------- business records
#: A wide business object.
ACCOUNTS = f"""
SELECT '001' || lpad({_text('c_custkey')}, 9, '0') AS Id,
  '005' || lpad({_text('c_nationkey')}, 6, '0') AS OwnerId,
  c_name AS Name,
  c_mktsegment AS Industry,
  c_acctbal AS AnnualRevenue,
  CASE WHEN c_custkey % 5 = 0 THEN '  WID-' || {_text('c_custkey')} || ' ' ELSE 'WID-' || {_text('c_custkey')} END AS Website_ID__c,
  CASE WHEN c_custkey % 7 = 0 THEN ' ' WHEN c_custkey % 2 = 0 THEN ' User' || {_text('c_custkey')} || '@Example.COM '
       ELSE 'user' || {_text('c_custkey')} || '@example.com' END AS Contact_Email__c,
  '555-' || {_text('c_custkey')} AS Phone,
  'group ' || {_text('c_custkey % 4')} AS Ethnicity__c,
  ' sw' || {_text('c_custkey % 20')} || 'a ' || {_text('c_custkey % 9')} || 'aa' AS MailingPostalCode,
  CASE WHEN c_custkey % 11 = 0 THEN 'unknown' ELSE {_text('1930 + c_custkey % 70')} || '-05-01' END AS Birthdate,
  c_custkey % 2 = 0 AS IsActive
FROM $customer
"""
ACCOUNT_FIELDS = [
    # name, type, label, length
    ("Id", "id", "Account ID", 18),
    ("OwnerId", "reference", "Owner ID", 18),
    ("Name", "string", "Account Name", 255),
    ("Industry", "picklist", "Industry", 40),
    ("AnnualRevenue", "currency", "Annual Revenue", 0),
    ("Website_ID__c", "string", "Website ID", 50),
    ("Contact_Email__c", "email", "Contact Email", 80),
    ("Phone", "phone", "Phone", 40),
    ("Ethnicity__c", "picklist", "Ethnicity", 40),
    ("MailingPostalCode", "string", "Mailing Zip", 20),
    ("Birthdate", "date", "Birthdate", 0),
    ("IsActive", "boolean", "Active", 0),
]

# name, type, label, length (-1: from the row), custom, calculated, formula, help
#: A field for every word that a rule looks for, then fields that meet a rule by type, length, label or help, or none.
_RECORD_FIELDS = [
    *[(word, "string", "Sync", 20, False, False, "", "") for word in rules.PARTNER_ID_NAMES],
    *[(f"Survey_{word}__c", "picklist", "Survey", 40, True, False, "", "") for word in rules.SPECIAL_CATEGORY],
    *[(f"Guest_{word}__c", "string", "Guest", 80, True, False, "", "") for word in rules.DIRECT_PII],
    *[(f"Usher_{word}__c", "textarea", "Usher", -1, True, False, "", "") for word in rules.ESSAY_NAMES],
    *[(f"Ticket_{word}__c", "string", "Ticket", 30, True, False, "", "") for word in rules.IDENTIFIERS],
    *[(f"Copied_{i}__c", "string", "Copied", 90, True, True, f"Booking__r.{name} & ' '", "") for i, name in enumerate(rules.FORMULA_SOURCES)],
    ("Id", "id", "Row key", 18, False, False, "", ""),
    ("Name", "string", "Shown as", 255, False, False, "", ""),
    ("Theatre__c", "reference", "Theatre", 18, True, False, "", ""),
    ("Street_Map__c", "reference", "Map", 18, True, False, "", ""),
    ("Box_Office_Mail__c", "email", "Box office", 80, True, False, "", ""),
    ("Newsletter_Email__c", "email", "Newsletter", 80, True, False, "", ""),
    ("Reply_To__c", "string", "Reply", 80, True, False, "", "an email of the box office"),
    ("Email_Weekly__c", "boolean", "Weekly", 0, True, False, "", ""),
    ("Programme_Text__c", "textarea", "Programme", 40_000, True, False, "", ""),
    ("Row_And_Seat__c", "string", "Seat", 10, True, False, "", ""),
    ("Interval_Drinks__c", "double", "Drinks", 0, True, False, "", ""),
    ("Gross__c", "currency", "Gross", 0, True, True, "Seats__c * Price__c", ""),
    ("Opens_On__c", "datetime", "Opens", 0, True, False, "", ""),
    ("Genre__c", "picklist", "Genre", 40, True, False, "", ""),
    ("Reach__c", "string", "Mobile of the stage door", 40, True, False, "", ""),
    ("Sold_Out__c", "boolean", "Sold out", 0, True, False, "", ""),
]
N_RECORD_FIELDS = len(_RECORD_FIELDS)

#: Describe rows of business objects, all fields to an object.
FIELDS = f"""
SELECT 'Obj' || {_text(_whole('p.p_partkey', N_RECORD_FIELDS))} AS object,
  CAST(v.pos AS INT) AS position, v.name AS name, v.label || ' ' || p.p_name AS label, v.type AS type,
  CASE WHEN v.len < 0 THEN p.p_size * 1000 ELSE v.len END AS length,
  v.custom AS custom, v.calculated AS calculated, v.formula AS formula,
  v.help || ' ' || lower(p.p_type) AS help_text, p.p_partkey AS k
FROM $part p JOIN (SELECT * FROM (VALUES {_values([(i, *row) for i, row in enumerate(_RECORD_FIELDS)])})
  AS x(pos, name, type, label, len, custom, calculated, formula, help)) v
  ON v.pos = p.p_partkey % {N_RECORD_FIELDS}
"""

#: Reviewed overrides: some objects expose, hide or derive a field.
OVERRIDES = """
SELECT object, name AS field,
  CASE WHEN k % 9 = 0 THEN 'KEEP' WHEN k % 9 = 1 THEN 'DROP' WHEN k % 9 = 2 THEN 'HASH_ID'
       WHEN k % 9 = 3 THEN 'DERIVE' ELSE 'PASS' END AS action
FROM fields WHERE k % 9 <= 4 AND length(label) % 2 = 0
"""
REASONS = "SELECT object, name AS field, 'approved ' || label AS text FROM fields WHERE length(label) % 3 = 0"
KNOWN = "SELECT object, name AS field FROM fields WHERE custom = false OR length(label) % 4 <> 0"

# ---------------------------------------------------------------- event columns
#: The names that the rules fix, then names that meet a suffix, a word, or no rule.
_EVENT_COLUMNS = (
    *rules.EVENT_IP,
    *rules.EVENT_URL,
    *rules.EVENT_PERSON,
    *rules.EVENT_CONTENT,
    *rules.EVENT_KEYS,
    "EDGE_IP",
    "LANDING_URL",
    "ICON_URI",
    "BASKET_ID",
    "BASKET_ID_DERIVED",
    "LABEL_IDS",
    "BANNER_MESSAGE",
    "FOOTER_TEXT",
    "TRAILING_HEADERS",
    "PASSWORD_CHANGED_AT",
    "SECRET_ROTATION",
    "TOKEN_KIND",
    "CREDENTIAL_STORE",
    "WAREHOUSE_ZONE",
    "ROWS_SHIPPED",
    "IDLE_SECONDS",
    "CARRIER",
    "IPX_ROUTE",
    "URL_COUNT",
)
N_EVENT_COLUMNS = len(_EVENT_COLUMNS)

#: Columns of event-log headers in changing spelling, one row per event type and column.
EVENT_COLUMNS = f"""
SELECT 'Type' || {_text(_whole('p.p_partkey', N_EVENT_COLUMNS) + ' % 64')} AS event_type,
  CASE WHEN p.p_size % 3 = 0 THEN ' ' || lower(v.name) || ' ' ELSE v.name END AS col_name,
  v.name AS key, p.p_partkey AS k
FROM $part p JOIN (SELECT * FROM (VALUES {_values(list(enumerate(_EVENT_COLUMNS)))}) AS x(pos, name)) v
  ON v.pos = p.p_partkey % {N_EVENT_COLUMNS}
"""

# ---------------------------------------------------------------- technical fields
_TECHNICAL_FIELDS = [
    # object, name, type, queryable
    ("FlowInterview", "InterviewLabel", "string", True),
    ("FlowInterview", "PauseLabel", "string", True),
    ("FlowInterview", "CurrentElement", "string", True),
    ("SetupAuditTrail", "Display", "string", True),
    ("SetupAuditTrail", "DelegateUser", "string", True),
    ("SetupAuditTrail", "Action", "string", True),
    ("IdpEventLog", "IdentityUsed", "string", True),
    ("Organization", "PrimaryContact", "string", True),
    ("Organization", "Phone", "phone", True),
    ("Organization", "Address", "address", True),
    ("AsyncApexJob", "ExtendedStatus", "string", True),
    ("BackgroundOperation", "Error", "string", True),
    ("BackgroundOperation", "ParentKey", "string", True),
    ("ApexLog", "Status", "string", True),
    ("ApexLog", "LogUserId", "reference", True),
    ("VerificationHistory", "Remarks", "string", True),
    ("VerificationHistory", "SourceIp", "string", True),
    ("LoginHistory", "Id", "id", True),
    ("LoginHistory", "UserId", "reference", True),
    ("LoginHistory", "SourceIp", "string", True),
    ("LoginHistory", "Status", "string", True),
    ("LoginHistory", "LoginUrl", "string", True),
    ("LoginHistory", "CountryIso", "string", True),
    ("LoginGeo", "Latitude", "double", True),
    ("LoginGeo", "Longitude", "double", True),
    ("LoginGeo", "City", "string", True),
    ("LoginGeo", "PostalCode", "string", True),
    ("LoginGeo", "Country", "string", True),
    ("LoginGeo", "Subdivision", "string", True),
    ("CronTrigger", "CronExpression", "string", True),
    ("ApexTestResult", "Message", "string", True),
    ("ApexTestResult", "StackTrace", "textarea", True),
    ("ApexClass", "Body", "string", True),
    ("ApexClass", "SymbolTable", "complexvalue", True),
    ("ApexClass", "ApiVersion", "double", True),
    ("ApexClass", "Status", "picklist", True),
    ("ApexClass", "Name", "string", True),
    ("ApexClass", "Setting", "anyType", True),
    ("Group", "Email", "email", True),
    ("Group", "DoesSendEmailToMembers", "boolean", True),
    ("AuthSession", "UsersId", "string", True),
    ("AuthSession", "LogoutUrl", "url", True),
    ("AuthSession", "LoginHostIp", "string", False),
    ("PermissionSet", "Description", "string", True),
    ("PermissionSet", "PermissionsModifyAllData", "boolean", True),
    ("RecordType", "NamespacePrefix", "string", True),
    ("Profile", "UserType", "picklist", True),
    ("UserRole", "MayForecastManagerShare", "boolean", True),
]
N_TECHNICAL_FIELDS = len(_TECHNICAL_FIELDS)

#: Describe rows of technical objects, one organisation per 48 parts.
TECHNICAL = f"""
SELECT 'org' || {_text(_whole('p.p_partkey', N_TECHNICAL_FIELDS))} AS org, v.object AS object, v.name AS name,
  CASE WHEN p.p_size % 10 = 0 AND v.type = 'string' THEN 'email' ELSE v.type END AS type,
  v.queryable AND p.p_size % 25 <> 0 AS queryable, p.p_partkey AS k
FROM $part p JOIN (SELECT * FROM (VALUES {_values([(i, *row) for i, row in enumerate(_TECHNICAL_FIELDS)])})
  AS x(pos, object, name, type, queryable)) v ON v.pos = p.p_partkey % {N_TECHNICAL_FIELDS}
"""
T_OVERRIDES = """
SELECT org, object, name AS field,
  CASE WHEN k % 7 = 0 THEN 'KEEP' WHEN k % 7 = 1 THEN 'HASH' WHEN k % 7 = 2 THEN 'DROP'
       WHEN k % 7 = 3 THEN 'DERIVE' ELSE 'RAW' END AS action
FROM technical WHERE k % 7 <= 4
"""
T_REASONS = "SELECT org, object, name AS field, 'ticket ' || org AS text FROM technical WHERE k % 2 = 0"

# ---------------------------------------------------------------- components
_TYPES = (
    "ApexClass CustomObject Flow Report Dashboard EmailTemplate Document Profile ConnectedApp StaticResource "
    "LightningComponentBundle AuraDefinitionBundle ExperienceBundle WaveDashboard Layout ReportFolder "
    "DashboardFolder ApexTrigger CustomField SiteDotCom FlowDefinition PermissionSet DecisionTable CustomLabel Role"
).split()

#: One listing row per part: type by brand, some in folders, some refused.
LISTING = f"""
SELECT v.type AS type,
  CASE WHEN v.type IN ('Report', 'Dashboard', 'EmailTemplate', 'Document') THEN
    CASE WHEN p.p_size % 4 = 0 THEN 'unfiled$$public' ELSE 'Folder' || {_text('p.p_size % 6')} END END AS folder,
  CASE WHEN p.p_size % 17 = 0 THEN CAST(NULL AS STRING)
       WHEN v.type IN ('ReportFolder', 'DashboardFolder') THEN 'Folder' || {_text('p.p_partkey % 5')}
       ELSE p.p_name || '_' || {_text('p.p_partkey')} END AS member,
  CASE WHEN p.p_size % 17 <> 0 THEN CAST(NULL AS STRING)
       WHEN p.p_partkey % 3 = 0 THEN '500 Fault: INSUFFICIENT_ACCESS: no access to ' || v.type
       WHEN p.p_partkey % 3 = 1 THEN 'Fault: Cannot use: ' || v.type || ' in this organization'
       ELSE 'unexpected ' || repeat('x', CAST(p.p_size * 10 AS INT)) END AS error
FROM $part p JOIN (SELECT * FROM (VALUES {_values([(f'Brand#{i + 1}', t) for i, t in enumerate(_TYPES)])}) AS x(brand, type)) v
  ON v.brand = p.p_brand
"""
DESCRIBED = """
SELECT DISTINCT type, type IN ('Report', 'Dashboard', 'EmailTemplate', 'Document') AS in_folder
FROM listing WHERE type NOT IN ('ApexTrigger', 'CustomLabel', 'ReportFolder', 'DashboardFolder')
"""
#: Components by type and member, and those some line item of 1998 brought back.
COMPONENTS = f"""
SELECT v.type AS type, p.p_name || '_' || {_text('p.p_partkey')} AS member, p.p_partkey AS k
FROM $part p JOIN (SELECT * FROM (VALUES {_values([(f'Brand#{i + 1}', t) for i, t in enumerate(_TYPES)])}) AS x(brand, type)) v
  ON v.brand = p.p_brand
"""
#: Once per line of a part, of parts whose last line of all was shipped late enough.
RETRIEVED = f"""
SELECT v.type AS type, p.p_name || '_' || {_text('p.p_partkey')} AS member
FROM $lineitem l JOIN $part p ON l.l_partkey = p.p_partkey
JOIN (SELECT * FROM (VALUES {_values([(f'Brand#{i + 1}', t) for i, t in enumerate(_TYPES)])}) AS x(brand, type)) v
  ON v.brand = p.p_brand
JOIN (SELECT l_partkey FROM $lineitem GROUP BY l_partkey HAVING max(l_shipdate) >= TIMESTAMP '2001-08-01 00:00:00') late
  ON late.l_partkey = p.p_partkey
"""

# ---------------------------------------------------------------- reports
VIOLATIONS = f"""
SELECT l_returnflag || l_linestatus || {_text(_whole('l_quantity', 10))} AS rule,
  CASE l_linenumber WHEN 1 THEN 'pmd' WHEN 2 THEN 'pmd' WHEN 3 THEN 'eslint' WHEN 4 THEN 'regex'
       WHEN 5 THEN 'retire-js' WHEN 6 THEN 'cpd' ELSE 'flow' END AS engine,
  CAST(1 + l_orderkey % 5 AS INT) AS severity, 'classes/File' || {_text('l_partkey')} || '.cls' AS file,
  CAST(l_quantity AS INT) AS line, l_orderkey AS l_orderkey, l_suppkey AS l_suppkey, l_linenumber AS l_linenumber,
  CASE WHEN l_returnflag = 'A' THEN 'Security,Recommended' WHEN l_returnflag = 'N' THEN 'Performance' ELSE 'Recommended' END AS tag_list
FROM $lineitem
"""
RISKS = f"""
SELECT n.n_name || '-' || {_text(_whole('s.s_suppkey', 40))} AS org, r.r_name || 'Settings' AS SettingGroup,
  CASE WHEN s.s_acctbal < 0 THEN 'HIGH_RISK' WHEN s.s_acctbal < 2000 THEN 'MEDIUM_RISK'
       WHEN s.s_acctbal < 5000 THEN 'LOW_RISK' WHEN s.s_acctbal < 7000 THEN 'INFORMATIONAL'
       ELSE 'MEETS_STANDARD' END AS RiskType,
  s.s_name AS Setting, {_text('CAST(floor(s.s_acctbal) AS BIGINT)')} AS OrgValue, '5' AS StandardValue,
  {_whole('s.s_suppkey', 8)} % 5 AS page, s.s_suppkey AS k
FROM $supplier s JOIN $nation n ON s.s_nationkey = n.n_nationkey JOIN $region r ON n.n_regionkey = r.r_regionkey
"""

# ---------------------------------------------------------------- windows
#: Folder names of finished days; the last ones lack their sentinel.
LEDGER = """
SELECT CAST(d AS STRING) || CASE WHEN extract(day FROM d) = 9 THEN '_till_' ELSE '_to_' END || CAST(d AS STRING) AS name,
  d < DATE '2024-01-16' AS sentinel, n
FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM $events GROUP BY CAST(ts AS DATE)) x
WHERE d < DATE '2024-01-19'
"""

# ---------------------------------------------------------------- paths and log dates
PATHS = f"""
SELECT p_partkey,
  CASE p_partkey % 6
    WHEN 0 THEN '/objects/Acc<' || p_name || '>.field'
    WHEN 1 THEN 'classes/' || repeat('A', CAST(100 + p_size AS INT)) || '.cls'
    WHEN 2 THEN '../' || p_name || '.txt'
    WHEN 3 THEN 'a/./b/' || p_name || '. .'
    WHEN 4 THEN 'x/../' || p_name || '|' || {_text('p_partkey')}
    ELSE 'layouts/' || p_name || '-' || {_text('p_partkey')} || '.layout' END AS path
FROM $part
"""
LOG_DATES = f"""
SELECT event_id,
  CASE event_id % 5
    WHEN 0 THEN {_text('CAST(ts AS DATE)')} || 'T01:02:03.000+0000'
    WHEN 1 THEN {_text('CAST(ts AS DATE)')}
    WHEN 2 THEN 'no-date-here-T00'
    WHEN 3 THEN '2024-13-45T00:00:00Z'
    ELSE '' END AS raw,
  CASE event_id % 4
    WHEN 0 THEN {_text('CAST(ts AS DATE)')} || '_to_' || {_text('CAST(ts AS DATE)')}
    WHEN 1 THEN 'x_to_2024-1-5'
    WHEN 2 THEN 'a_to_b_to_2024-01-05'
    ELSE 'scratch' END AS window_name,
  CAST(ts AS DATE) AS d
FROM $events
"""
