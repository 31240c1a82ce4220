"""Account codes and their concepts, and word lists that decide classes."""

from __future__ import annotations

#: Statement and account code of each concept.
CONCEPTS = {
    "balance_sheet": {
        "1D0109": "cash_and_cash_equivalents",
        "1D01ST": "current_assets",
        "1D0309": "current_borrowings",
        "1D020T": "total_assets",
        "1D03ST": "current_liabilities",
        "1D0401": "non_current_borrowings",
        "1D040T": "total_liabilities",
        "1D07ST": "total_equity",
        "1D070T": "total_liabilities_and_equity",
    },
    "income_statement": {
        "2D01ST": "revenue",
        "2D0201": "cost_of_sales",
        "2D02ST": "gross_profit",
        "2D0302": "selling_expenses",
        "2D0301": "administrative_expenses",
        "2D0403": "other_operating_income",
        "2D0404": "other_operating_expenses",
        "2D03ST": "operating_profit",
        "2D0401": "finance_income",
        "2D0402": "finance_costs",
        "2D0406": "share_of_profit_associates",
        "2D0410": "foreign_exchange_result",
        "2D04ST": "profit_before_tax",
        "2D0502": "income_tax_expense",
        "2D0503": "profit_continuing_operations",
        "2D0504": "profit_discontinued_operations",
        "2D07ST": "net_profit",
        "2D0802": "net_profit_owners",
        "2D0803": "net_profit_non_controlling",
        "2D0911": "basic_earnings_per_common_share",
    },
    "cash_flow": {
        "3D01ST": "operating_cash_flow",
        "3D0206": "purchases_property_plant_equipment",
        "3D02ST": "investing_cash_flow",
        "3D0325": "borrowings_received",
        "3D0330": "debt_repayments",
        "3D0305": "dividends_paid",
        "3D03ST": "financing_cash_flow",
        "3D0401": "net_change_before_exchange_rate_effects",
        "3D0404": "exchange_rate_effect_on_cash",
        "3D0405": "net_change_in_cash",
        "3D0402": "opening_cash",
        "3D04ST": "closing_cash",
    },
}

#: Topics and the words of their titles, in order of precedence.
TOPIC_RULES = (
    ("subsequent_events", ("hechos posteriores", "eventos posteriores", "eventos subsecuentes")),
    ("segments", ("segmento",)),
    ("contingencies", ("contingenc", "compromiso")),
    ("related_parties", ("relacionad", "entidades asociadas", "partes relacionadas")),
    ("estimates", ("juicios", "estimad", "supuestos significativos")),
    ("impairment", ("deterioro",)),
    ("provisions_closure", ("provisiones", "cierre de minas", "cierre de unidades")),
    ("debt", ("obligaciones financieras", "deuda", "borrowings")),
    ("capex_assets", ("propiedad, planta", "property, plant", "concesiones mineras", "costos de desarrollo")),
)

#: Words in sentences that speak for a topic.
TOPIC_KEYWORDS = {
    "debt": ("deuda", "obligacion", "prestamo", "bono", "financiam", "covenant", "credito"),
    "segments": ("segmento", "unidad", "operacion", "produccion", "venta", "ingreso"),
    "capex_assets": ("activo", "propiedad", "planta", "equipo", "desarrollo", "capex", "inversion"),
    "impairment": ("deterioro", "recuperable", "desvaloriz", "valor en uso", "provision"),
    "provisions_closure": ("provision", "cierre", "remediacion", "ambiental", "desmantel"),
    "contingencies": ("contingencia", "proceso", "litigio", "sunat", "demanda", "reclamacion"),
    "related_parties": ("relacionad", "vinculad", "directorio", "gerencia", "accionista"),
    "estimates": ("estimacion", "supuesto", "juicio", "incertidumbre", "sensibilidad"),
    "subsequent_events": ("posterior", "subsecuente", "dividendo", "emision", "directorio"),
    "other": ("increment", "disminu", "saldo", "importe", "resultado", "operacion"),
}
#: Words of material sentences, and verbs of narrative ones.
MATERIAL_TERMS = ("increment", "disminu", "cumpl", "pendiente", "significativ", "restric", "riesgo", "vencimiento", "cancel", "pago", "emision", "aprobo", "acordo", "no ha hecho uso")
NARRATIVE_VERBS = ("acordo", "aprobo", "asciende", "cancel", "considera", "corresponde", "efectuo", "emitio", "firmo", "mantiene", "reconocio", "registro", "suscribio", "tiene")

#: Words of titles that carry no meaning, and words that stand for one another.
TITLE_STOP_WORDS = ("a", "al", "con", "de", "del", "el", "en", "la", "las", "los", "neto", "neta", "netos", "netas", "otras", "otros", "para", "por", "sobre", "y")
TITLE_ALIASES = {
    "actividad": "actividad", "actividades": "actividad", "evento": "posterior", "eventos": "posterior", "hecho": "posterior", "hechos": "posterior",
    "ingreso": "ventas", "ingresos": "ventas", "ordinaria": "ventas", "ordinarias": "ventas", "posterior": "posterior", "posteriores": "posterior",
    "subsecuente": "posterior", "subsecuentes": "posterior", "venta": "ventas", "ventas": "ventas",
}

#: Who is supported, by sector hints and activity codes.
FINANCE_HINTS = ("banco", "bank", "seguro", "asegur", "financiera", "afp", "fondo de inversion", "fondo mutuo")
MINING_HINTS = ("miner", "mining", "extraccion de minerales", "metalif")
FULL_ACTIVITY = ("07", "08")
UNSUPPORTED_ACTIVITY = ("64", "65", "66")

#: Event categories, topics and terms of priority, titles without meaning and exceptional texts, and job steps.
EVENT_CATEGORIES = ("dividends", "management", "meetings", "debt", "operations", "litigation", "production", "other")
PRIORITY_TOPICS = ("debt", "contingencies", "related_parties", "impairment", "provisions_closure", "subsequent_events", "estimates")
RISK_TERMS = ("deuda", "préstamo", "contingenc", "litig", "vinculad", "relacionad", "deterior", "provisi", "compromis", "posterior", "liquidez", "vencimiento", "garantia", "covenant", "incumplimiento", "tributari", "impuesto", "inventario", "cobrar", "segmento")
GENERIC_TITLES = ("informacion general", "actividad economica", "identificacion", "bases de preparacion", "politicas contables", "constitucion")
EXCEPTIONAL_TEXT = ("empresa en marcha", "incumplimiento", "reexpresion", "salvedad", "cambio de politica", "cambios en las politicas", "incertidumbre material")
JOB_STEPS = ("statements", "metrics", "documents", "summaries")

#: Patterns of sentences, advice, unit headers, numbers and covers.
LEADING_PAGE_NUMBER = r"^\s*[0-9]{1,3}\s+(?=[A-ZÁÉÍÓÚÑ(\-])"
SENTENCE_BOUNDARY = r"(?<=[.!?])\s+(?=(?:-\s*[A-ZÁÉÍÓÚÑ0-9]|\([a-z]\)|[A-ZÁÉÍÓÚÑ0-9]))"
COLLAPSED_BOUNDARY = SENTENCE_BOUNDARY.replace(r"(?<=[.!?])\s+", " (?<=[.!?] )")  # the same where white space is single spaces; most characters fail it at once
ADVICE_VERBS = ("comprar", "vender", "mantener")
INVESTMENT_ADVICE = r"\b(?:comprar|vender|mantener)\b.{0,50}\b(?:accion|acciones|valor|valores|inversion)\b"
BOILERPLATE_BEGINNINGS = ("a continuacion presentamos", "a continuacion se presenta")
STANDARD_PHRASE = "normas internacionales de informacion financiera"
MONEY_OR_PERCENT = r"US\$|S/|%|\b[0-9]{1,3}(?:[.,][0-9]{3})+"
DOLLARS, SOLES = r"us\s*\$|dolares", r"s/|soles"
SCALE_WORDS = (("thousands", r"\(\s*0{3}\s*\)|\bmiles\b"), ("millions", r"\bmillones\b"), ("units", r"\bunidades\b|expresad[oa]s? en (?:soles|dolares)"))
COVER_PERIOD = r"(estados financieros.{0,100}?31 de diciembre de 20[0-9]{2})"
LABEL_ALIAS = ("propiedades", "propiedad")
LABEL_STOP_WORDS = ("de", "del", "y", "la", "el", "los", "las", "neto", "netos")

# The page of a presentation policy, its statement, its exceptions, and those exceptions that leave the unit as it is.
POLICY_PAGE = r"bases de preparacion|moneda de presentacion"
POLICY_STATEMENT = r"(?:los |estos )estados financieros(?: consolidados| separados| individuales)? se (?:presentan|expresan)[^.]{0,400}\."
POLICY_EXCEPTION = r"excepto[^.]*|salvo[^.]*"
POLICY_ALLOWED = ("excepto donde se indique de otro modo", "excepto donde se indique lo contrario", "salvo que se indique lo contrario")

# The line over all notes, the heading of note 3 that lost its number, headings behind the notes, a title that goes on in the next
# line, a title that needs no capitals, the words that no title ends with, and the line of a page number.
NOTES_MARKER = "notas a los estados financieros"
UNNUMBERED_HEADING = (3, "Juicios, estimados y supuestos contables significativos")
APPENDIX_BEGINNINGS = r"informaci[oó]n suplementaria|recursos minerales y reservas probadas y probables|informe de (?:los )?auditores independientes"
WRAPPED_TITLE = ("estado consolidado de situacion", "FINANCIERA")
KNOWN_TITLE = "jerarquia y valor razonable de los instrumentos financieros"
TITLE_LAST_WORDS = ("al", "con", "de", "del", "el", "en", "la", "las", "los", "o", "para", "por", "que", "un", "una", "y")
PAGE_NUMBER_LINE = r"^pagina [0-9]+(?: de [0-9]+)?$"

# Labels that stand for a concept in tables, a line of years only, and words that name a unit or currency.
ANCHOR_ALIASES = (
    ("profit_before_tax", "utilidad antes de impuesto a la renta"),
    ("income_tax_expense", "total impuesto a la renta"),
    ("cash_and_cash_equivalents", "efectivo y equivalentes del efectivo"),
    ("closing_cash", "efectivo y equivalentes del efectivo"),
)
YEARS_LINE = r"^\s*20[0-9]{2}(?:\s+20[0-9]{2}){1,2}\s*$"
UNIT_WORDS = r"s/|us\s*\$|miles|millones|unidades"
