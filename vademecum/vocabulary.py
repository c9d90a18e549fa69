"""Fixed vocabularies and limits of the handbook jobs."""

# The section types, in order.
SECTION_TYPES = [
    "prescriber_highlights", "indications", "contraindications", "adverse_effects", "reproductive_safety", "overdose_toxicity",
    "drug_interactions", "laboratory_considerations", "pharmacology", "pharmacokinetics", "monitoring", "client_information",
    "chemistry", "storage", "compounding", "dosage_forms", "doses", "other",
]

# Section type of each header line after spacing is normalised.
HEADER_SECTIONS = {
    "Prescriber Highlights": "prescriber_highlights",
    "Uses/Indications": "indications",
    "Indications/Actions": "indications",
    "Contraindications/Precautions/Warnings": "contraindications",
    "Contraindications/Precautions": "contraindications",
    "Precautions/Adverse Effects": "contraindications",
    "Adverse Effects": "adverse_effects",
    "Reproductive/Nursing Safety": "reproductive_safety",
    "Overdose/Acute Toxicity": "overdose_toxicity",
    "Overdosage/Acute Toxicity": "overdose_toxicity",
    "Overdose/Toxicity": "overdose_toxicity",
    "Overdoses/Acute Toxicity": "overdose_toxicity",
    "Drug Interactions": "drug_interactions",
    "Laboratory Considerations": "laboratory_considerations",
    "Laboratory Interactions": "laboratory_considerations",
    "Pharmacology/Actions": "pharmacology",
    "Pharmacology": "pharmacology",
    "Pharmacokinetics": "pharmacokinetics",
    "Monitoring": "monitoring",
    "Client Information": "client_information",
    "Chemistry/Synonyms": "chemistry",
    "Chemistry": "chemistry",
    "Storage/Stability": "storage",
    "Compatibility/Compounding Considerations": "compounding",
    "Dosage Forms/Regulatory Status": "dosage_forms",
    "Dose Forms/Regulatory Status": "dosage_forms",
    "Dosages": "doses",
    "Doses": "doses",
    "Suggested Dosages/Uses": "doses",
    "Suggested Uses/Dosages": "doses",
    "Suggested Dosages/Use": "doses",
}

# Species of each word.
SPECIES_WORDS = {
    "dog": "dog", "dogs": "dog",
    "cat": "cat", "cats": "cat",
    "horse": "horse", "horses": "horse", "equine": "horse",
    "ferret": "ferret", "ferrets": "ferret",
    "rabbit": "rabbit", "rabbits": "rabbit",
    "bird": "bird", "birds": "bird", "avian": "bird", "avians": "bird",
    "poultry": "poultry",
    "cattle": "cattle", "cow": "cattle", "cows": "cattle",
    "swine": "swine", "pig": "swine", "pigs": "swine",
    "sheep": "sheep",
    "goat": "goat", "goats": "goat",
    "ruminant": "ruminant", "ruminants": "ruminant",
    "camelid": "camelid", "camelids": "camelid",
    "llama": "llama", "llamas": "llama",
    "alpaca": "alpaca", "alpacas": "alpaca",
    "deer": "deer",
    "reptile": "reptile", "reptiles": "reptile",
    "turtle": "reptile", "turtles": "reptile", "tortoise": "reptile", "tortoises": "reptile",
    "amphibian": "amphibian", "amphibians": "amphibian",
    "fish": "fish",
    "hedgehog": "hedgehog", "hedgehogs": "hedgehog",
    "mammal": "small mammal", "mammals": "small mammal",
    "bee": "bee", "bees": "bee",
}

# Words of header-shaped lines that are notes or routes.
NOTE_WORDS = ["note", "notes", "warning", "warnings", "caution", "cautions", "im", "iv", "po", "sc", "sq", "it", "ip", "sl"]

# The section that answers each kind of question.
FLOW_SECTIONS = {
    "dose": "doses",
    "indication": "indications",
    "contraindication": "contraindications",
    "reproductive_safety": "reproductive_safety",
    "interaction": "drug_interactions",
    "adverse_effects": "adverse_effects",
    "monitoring": "monitoring",
    "administration": "client_information",
}

# Patterns, namespaces and limits.
TOC_ENTRY = r"^([A-Za-z][A-Za-z0-9 ,/()'+-]+?)\s+(\d{1,4})$"
SPECIES_HEADER = r"^[A-Z][A-Z &/]{0,40}:$"
POINT_NAMESPACE = "5b3d2c1a-9e8f-4a7b-8c6d-1f2e3a4b5c6d"
LB_IN_KG = "0.45359237"
MAX_WEIGHT_KG, MAX_MG_PER_KG, MAX_TOP_K = 5000, 10_000, 20
MATCH_CUTOFF, SUGGEST_CUTOFF = 0.85, 0.6
MAX_CHUNK_CHARS = 1200
HEADING_PAGES = 2
RERANK_CANDIDATES = 20
COMPANIONS = ["dog", "cat"]
