"""Curated entities and vocabularies: the default values; every operator takes others instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LEXICON_SCHEMA = "seq int, canonical_id string, canonical_name string, type string, description string, aliases array<string>"

# The curated entities (id, name, type, description, aliases).
CLUSTERS = (
    ("entity:product:nova", "Product Nova", "PRODUCT", "CloudScale's flagship distributed cloud analytics platform", ("Nova", "Product Nova", "Nova Platform", "Nova Analytics")),
    ("entity:product:orion", "Product Orion", "PRODUCT", "Distributed event broker and stream routing engine backed by Apache Kafka", ("Orion", "Product Orion", "Orion Broker", "Orion Streaming")),
    ("entity:product:atlas", "Product Atlas", "PRODUCT", "Enterprise compliance, policy administration, and audit portal", ("Atlas", "Product Atlas", "Atlas Portal", "Governance Portal")),
    ("entity:product:vega", "Product Vega", "PRODUCT", "High-throughput time-series telemetry and metric engine", ("Vega", "Product Vega", "Vega Engine", "Vega Telemetry")),
    ("entity:service:identity_service", "Identity Service", "SERVICE", "Centralized authentication and OAuth token issuance service", ("Identity Service", "IdP", "Identity Provider", "Auth Service")),
    ("entity:service:policy_engine", "Policy Engine", "SERVICE", "Centralized authorization engine evaluating RBAC and ABAC policies", ("Policy Engine", "Centralized Policy Engine", "OPA Engine")),
    ("entity:service:gateway_service", "Gateway Service", "SERVICE", "Envoy-based API edge gateway enforcing mTLS and rate limiting", ("Gateway Service", "API Gateway", "Gateway Proxy")),
    ("entity:service:data_anonymization_service", "Data Anonymization Service", "SERVICE", "Privacy engineering microservice performing PII redaction and tokenization", ("Data Anonymization Service", "Anonymization Service", "Privacy Service")),
    ("entity:service:billing_engine", "Billing Engine", "SERVICE", "Financial metering and tenant invoicing calculation engine", ("Billing Engine", "Metering Engine")),
    ("entity:customer:acme_corp", "Acme Corp", "CUSTOMER", "Multinational retail and logistics enterprise subscriber on AWS", ("Acme Corp", "Acme", "Acme Corporation")),
    ("entity:customer:globex_corp", "Globex Corp", "CUSTOMER", "European financial services and fintech conglomerate on Azure", ("Globex Corp", "Globex", "Globex Corporation")),
    ("entity:customer:initech", "Initech", "CUSTOMER", "Defense, aerospace, and high-security manufacturing contractor", ("Initech", "Initech Defense")),
    ("entity:version:version_3_2", "Version 3.2", "VERSION", "Platform release enforcing OAuth 2.1 and Arrow columnar caching", ("Version 3.2", "v3.2", "3.2", "Polaris", "Release 3.2")),
    ("entity:version:version_3_1", "Version 3.1", "VERSION", "Platform release launching Product Vega and Azure AKS support", ("Version 3.1", "v3.1", "3.1", "Centauri")),
    ("entity:technology:oauth_2_1", "OAuth 2.1", "TECHNOLOGY", "Modern authorization framework requiring PKCE and deprecating implicit grant", ("OAuth 2.1", "OAuth2.1")),
    ("entity:technology:oauth_2_0", "OAuth 2.0", "TECHNOLOGY", "Legacy authorization framework with implicit grant support", ("OAuth 2.0", "OAuth2.0", "OAuth 2")),
    ("entity:incident:inc_402", "INC-402", "INCIDENT", "Version 3.2 token invalidation outage impacting Acme Corp ETL pipeline", ("INC-402", "Incident 402", "Incident INC-402")),
    ("entity:policy:soc2_type_ii", "SOC2 Type II", "POLICY", "Security, availability, and confidentiality audit certification", ("SOC2 Type II", "SOC2", "SOC 2", "SOC 2 Type II")),
    ("entity:policy:gdpr", "GDPR", "POLICY", "General Data Protection Regulation governing EU data privacy and residency", ("GDPR", "General Data Protection Regulation")),
    ("entity:organization:cloudscale", "CloudScale Systems", "ORGANIZATION", "Enterprise cloud intelligence and distributed data infrastructure provider", ("CloudScale Systems", "CloudScale", "CloudScale Corp")),
    ("entity:technology:kafka", "Apache Kafka", "TECHNOLOGY", "Distributed streaming event bus backing Product Orion", ("Apache Kafka", "Kafka", "Kafka Cluster")),
    ("entity:technology:arrow", "Apache Arrow", "TECHNOLOGY", "In-memory columnar data format used for Nova analytics caching", ("Apache Arrow", "Arrow", "Arrow Format")),
    ("entity:technology:redis", "Redis", "TECHNOLOGY", "In-memory key-value cache used for session and token management", ("Redis", "Redis Cache")),
    ("entity:technology:envoy", "Envoy Proxy", "TECHNOLOGY", "High-performance edge proxy underpinning Gateway Service", ("Envoy Proxy", "Envoy")),
    ("entity:plan:developer", "Developer Plan", "PLAN", "Entry-level free tier for prototyping and individual developers", ("Developer Plan", "Free Tier", "Developer Tier", "Free Plan", "Starter Tier")),
    ("entity:plan:pro", "Pro Plan", "PLAN", "Standard business plan with 99.9% SLA and dedicated support", ("Pro Plan", "Pro Tier", "Professional Plan", "Growth Tier")),
    ("entity:plan:enterprise", "Enterprise Plan", "PLAN", "Mission-critical custom enterprise plan with 99.99% SLA and HIPAA/SOC2", ("Enterprise Plan", "Enterprise Tier", "Custom Tier")),
)

# Extraction rules in the order they are tried (regex, type, description if no
# sentence holds the name).
ENTITY_RULES = (
    (r"\bProduct\s+(?:Nova|Orion|Atlas|Vega)\b", "PRODUCT", "CloudScale platform product"),
    (r"\b(?:Identity\s+Service|Policy\s+Engine|Gateway\s+Service|Data\s+Anonymization\s+Service|Billing\s+Engine|Authz\s+Service)\b", "SERVICE", "Core platform microservice"),
    (r"\b(?:Acme\s+Corp|Globex\s+Corp|Initech)\b", "CUSTOMER", "Enterprise customer organization"),
    (r"\b(?:OAuth\s+2\.[01]|PASETO\s*(?:v4)?|PKCE|JWT|Ed25519|mTLS|SAML\s*2\.0|Apache\s+Kafka|Apache\s+Arrow|Aurora\s+PostgreSQL)\b", "TECHNOLOGY", "Cryptographic protocol or technology standard"),
    (r"\b(?:AWS|Azure|Kubernetes|AWS\s+EKS|Azure\s+AKS|Amazon\s+S3|Azure\s+Blob\s+Storage)\b", "TECHNOLOGY", "Cloud infrastructure provider or service"),
    (r"\b(?:Version\s+)?(?:v3\.[012]|Version\s+3\.[012])\b", "VERSION", "Platform software release"),
    (r"\bINC-402\b", "INCIDENT", "Production incident report"),
    (r"\b(?:SOC2(?:\s+Type\s+II)?|GDPR|CCPA|ISO\s*27001|NIST\s*800-53|ITAR)\b", "POLICY", "Security, compliance, or regulatory framework"),
    (r"\b(?:Starter\s+Tier|Growth\s+Tier|Enterprise\s+Tier)\b", "PLAN", "Subscription contract tier"),
    (r"\bCloudScale\s+Systems\b", "ORGANIZATION", "Cloud intelligence and data infrastructure company"),
)

# Names that hold one of these words get the standard name, whatever their type.
STANDARD_NAMES = (
    ("identity", "Identity Service"), ("policy", "Policy Engine"), ("gateway", "Gateway Service"), ("anonymization", "Data Anonymization Service"),
    ("billing", "Billing Engine"), ("authz", "Authz Service"), ("oauth 2.1", "OAuth 2.1"), ("oauth 2.0", "OAuth 2.0"), ("soc2", "SOC2 Type II"),
)

# Cues of relations in the order they are tried (regex, type, description).
RELATION_CUES = (
    (r"\b(?:relies\s+on|depends\s+on|delegates\s+(?:all\s+)?(?:user\s+)?authentication\s+to|requires)\b", "DEPENDS_ON", "relies on for operational capabilities"),
    (r"\b(?:uses|utilizes|powers|subscribed\s+to|operates|contracts?\s+for)\b", "USES", "uses or consumes service/product"),
    (r"\b(?:affects|impacts|breaks|deprecated|replaces)\b", "AFFECTS", "adversely affects or changes interface of"),
    (r"\b(?:introduced\s+in|released\s+in|transitioned\s+(?:in|to)|rolled\s+out\s+in|upgraded\s+to)\b", "INTRODUCED_IN", "introduced or launched in release"),
    (r"\b(?:supports|provides|features|offers|enforces|implements)\b", "SUPPORTS", "provides or supports capability for"),
    (r"\b(?:deployed\s+(?:on|in)|hosted\s+(?:on|in)|runs\s+on)\b", "DEPLOYS_TO", "deploys onto infrastructure environment"),
    (r"\b(?:integrates\s+with|connects\s+to|exchanges\s+with|streams\s+into)\b", "INTEGRATES_WITH", "exchanges data or integrates with"),
    (r"\b(?:complies\s+with|satisfies|certified\s+under|audited\s+under)\b", "COMPLIES_WITH", "complies with regulatory policy or certification"),
    (r"\b(?:governed\s+by|evaluated\s+by|regulated\s+by|enforced\s+by)\b", "OWNED_BY", "governed or policy-enforced by"),
    (r"\b(?:part\s+of|component\s+of|subsystem\s+of|module\s+of)\b", "PART_OF", "part or component of"),
)

# Relations of neighbours without a cue (words in the source's or the target's name, type,
# description), in the order they are tried; the last holds for all.
PLAIN_RELATIONS = (
    ("source", ("customer", "corp"), "USES", "Customer utilizes target solution"),
    ("target", ("version",), "INTRODUCED_IN", "Associated with software release"),
    ("", (), "RELATED_TO", "Relates to context in chunk"),
)


def default_lexicon(spark: SparkSession) -> DataFrame:
    """The curated entities as a table."""
    rows = [(i, cid, name, kind, text, list(aliases)) for i, (cid, name, kind, text, aliases) in enumerate(CLUSTERS)]
    return spark.createDataFrame(rows, LEXICON_SCHEMA)
