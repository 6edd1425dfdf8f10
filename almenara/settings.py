"""Defaults that define results. Every operator takes them as arguments; nothing reads a file."""

from __future__ import annotations

from dataclasses import dataclass, field

# They must equal the published study's, or its results cannot be matched.

RESOLUTIVE_CATEGORIES = ("II-1", "II-2", "II-E", "III-1", "III-2", "III-E")
UPGRADABLE_CATEGORIES = ("I-3", "I-4")
CANONICAL_CATEGORIES = (
    "I-1", "I-2", "I-3", "I-4", "II-1", "II-2", "II-E", "III-1", "III-2", "III-E",
)
EMPTY_CATEGORY_WORDS = ("", "0", "NAN", "NONE", "SIN CATEGORIA", "S/C", "-")
NO_CATEGORY = "SIN_CATEGORIA"
ACTIVE_STATES = ("ACTIVO",)
UNKNOWN_STATE = "DESCONOCIDO"
URBAN_CATEGORIES = ("CIUDAD", "VILLA", "PUEBLO", "PP.JJ.AA.HH.", "BARRIO O CUARTEL")

METRES_PER_DEGREE_LAT = 110_540.0
METRES_PER_DEGREE_LON = 111_320.0

NOT_LOCATED = "NO_LOCALIZADO"
DEPARTMENTS = (
    "AMAZONAS", "ANCASH", "APURIMAC", "AREQUIPA", "AYACUCHO", "CAJAMARCA", "CALLAO", "CUSCO",
    "HUANCAVELICA", "HUANUCO", "ICA", "JUNIN", "LA LIBERTAD", "LAMBAYEQUE", "LIMA", "LORETO",
    "MADRE DE DIOS", "MOQUEGUA", "PASCO", "PIURA", "PUNO", "SAN MARTIN", "TACNA", "TUMBES",
    "UCAYALI",
)
DEPARTMENT_ALIASES = {
    "CUZCO": "CUSCO",
    "PROV. CONST. DEL CALLAO": "CALLAO",
    "PROVINCIA CONSTITUCIONAL DEL CALLAO": "CALLAO",
    "LIMA METROPOLITANA": "LIMA",
    "LIMA PROVINCIAS": "LIMA",
    "ANCASH": "ANCASH",
    "SAN MARTIN DE PORRES": "LIMA",
}

CHUNK_SEPARATORS = ("\nArtículo ", "\nArtculo ", "\n\n", "\n", ". ", " ")
CHUNK_SWEEP = ((500, 75), (900, 150), (1500, 200))

HEADER_PATTERNS = (
    r"\d{0,3}\s*NORMAS\s*LEGALES\s*(?:Lunes|Martes|Mi[eé]rcoles|Jueves|Viernes|S[aá]bado|Domingo)\s*\d{1,2}\s*de\s*[A-Za-zÁÉÍÓÚáéíóú]+\s*de\s*\d{4}\s*El\s*Peruano\s*/",
    r"El\s*Peruano\s*/",
    r"NORMAS\s*LEGALES",
    r"Reglamento\s+de\s+la\s+Ley\s+N[ºo°]?\s*32069[^\n]{0,80}",
    r"P[aá]gina\s+\d{1,3}\s+de\s+\d{1,3}",
    r"^\s*\d{1,3}\s*$",
    r"Firmado\s+Digitalmente\s+por[^\n]*",
    r"https?://\S*elperuano\S*",
)

TARIFFS = {
    "pico": {"entrada_cache_hit": 0.006, "entrada_cache_miss": 0.30, "salida": 1.20},
    "valle": {"entrada_cache_hit": 0.003, "entrada_cache_miss": 0.15, "salida": 0.60},
}
PEAK_HOURS_UTC = (("01:00", "04:00"), ("06:00", "10:00"))

ENDING_LABELS = {"mate": "Jaque mate", "resign": "Rendicion", "outoftime": "Tiempo"}

METHOD_CONCEPTS = {
    "Licitación Pública": "licitación pública, procedimiento de selección competitivo para bienes y obras",
    "Licitación Pública Abreviada": "licitación pública, procedimiento de selección competitivo para bienes y obras",
    "Licitación Pública Abreviada Homologación": "licitación pública, procedimiento de selección competitivo para bienes y obras",
    "Concurso Público": "concurso público, procedimiento de selección competitivo para servicios",
    "Concurso Público Abreviado": "concurso público, procedimiento de selección competitivo para servicios",
    "Concurso Público de Servicios": "concurso público, procedimiento de selección competitivo para servicios",
    "Concurso Público para Consultoría": "concurso público, procedimiento de selección competitivo para servicios",
    "Concurso Público Abreviado Homologación": "concurso público, procedimiento de selección competitivo para servicios",
    "Contratación Directa": "contratar directamente, procedimiento de selección no competitivo",
    "Subasta Inversa Electrónica": "subasta inversa electrónica",
    "Comparación de Precios": "comparación de precios",
    "Regímen Especial": "régimen especial de contratación",
    "Contratos Estandarizados": "contratos estandarizados",
    "Procedimiento Especial de Contratación": "procedimiento especial de contratación",
}
METHODS_WITHOUT_EQUIVALENT = (
    "Adjudicación Simplificada", "Adjudicación Selectiva", "Adjudicación Abreviada",
)
NO_EQUIVALENT_CONCEPT = "procedimientos de seleccion competitivos y no competitivos"
NO_EQUIVALENT_NOTICE = (
    "Atencion: «{metodo}» es un nombre de procedimiento de la Ley 30225, que SEACE sigue usando "
    "en sus datos. La Ley 32069 reorganizo los procedimientos en competitivos (articulo 54) y no "
    "competitivo (articulo 55), y ese nombre ya no aparece en ella. Lo que sigue responde por el "
    "concepto equivalente mas cercano."
)
OBJECT_WORDS = {"goods": "bienes", "works": "obras", "services": "servicios"}

# End of the fixed values.


@dataclass(frozen=True)
class BoundingBox:
    lon_min: float = -81.4
    lat_min: float = -18.4
    lon_max: float = -68.6
    lat_max: float = -0.04


@dataclass(frozen=True)
class AccessSettings:
    bands_min: tuple[int, ...] = (30, 60, 120)
    top_gaps: int = 20
    snap_threshold_m: float = 2000.0
    snap_sweep_m: tuple[int, ...] = (500, 1000, 2000, 5000, 10000)
    urban_population: float = 2000.0
    sample_cap: int = 5000
    seed: int = 42
    edge_tolerance_deg: float = 0.002
    box: BoundingBox = field(default_factory=BoundingBox)


@dataclass(frozen=True)
class RiskSettings:
    min_tenders_per_buyer: int = 15
    top_buyers: int = 10
    short_window_days: float = 3.0
    fuzzy_threshold: float = 88.0
    min_description_chars: int = 10
    min_amount: float = 0.0
    ranking_cap: int = 500


@dataclass(frozen=True)
class TextSettings:
    chunk_size: int = 900
    chunk_overlap: int = 150
    min_chars: int = 40
    low_text_chars: int = 200
    max_low_text_pct: float = 5.0
    glued_share: float = 0.15
    min_sample_chars: int = 200
    chars_per_token: float = 3.7
    token_limit: int = 512


@dataclass(frozen=True)
class RetrievalSettings:
    top_k: int = 5
    threshold: float = 0.82
    ks: tuple[int, ...] = (1, 3, 5)
    page_tolerance: int = 1
    threshold_sweep: tuple[float, ...] = (0.70, 0.74, 0.78, 0.80, 0.82, 0.84, 0.86, 0.90)
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25


ACCESS = AccessSettings()
RISK = RiskSettings()
TEXT = TextSettings()
RETRIEVAL = RetrievalSettings()
