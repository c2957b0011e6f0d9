"""Schemas of the domain: raw records, observations, sources and what stands around them. Nothing is inferred."""

from __future__ import annotations

# Column names and types of the exchanged tables, as DDL.
RAW_RECORD = (
    "banca string, sursa string, tip_sursa string, format string, rol_sursa string, frecventa_sursa string, amprenta string, concept string, tip string, rol string, "
    "valoare double, valoare_text string, moneda string, serviciu string, sectiune string, conditie string, frecventa string, detaliu string, pagina int, segment string, "
    "categorie string, canal string, destinatie string, perioada string, nr_rate int, citat string, incredere string, ambiguu boolean, motiv_ambiguu string, "
    "data_vigoare date, stare_data string, coloana string, produs string"
)
OBSERVATION = (
    "id bigint, created_at timestamp, banca string, id_sursa bigint, produs string, camp string, cod_scenariu string, valoare_num decimal(18,6), valoare_text string, "
    "unitate string, valuta string, citat string, confidence decimal(4,3), ambiguu boolean, metoda_extractie string, serviciu string, sectiune string, conditie string, "
    "frecventa string, detaliu string, pagina int, data_vigoare date, stare_data string, motiv_ambiguu string, nr_aparitii int, coloana string"
)
BANK = "id bigint, slug string, nume string, tier string, segment_real string, activ boolean, pagina_documente string, pagina_documente_motiv string"
SOURCE = (
    "id bigint, id_banca bigint, tip_sursa string, sursa string, rol string, format string, metoda string, robots_ok boolean, metoda_extractie string, frecventa string, "
    "status string, ultima_rulare timestamp, url_public string, nota_extractie string, created_at timestamp"
)
FINGERPRINT = "id bigint, created_at timestamp, id_sursa bigint, format string, hash string"
INDEX = "indice string, scadenta string, valoare decimal(6,4), valabil_din date, valabil_pana date, sursa string"
LOCATION = (
    "id bigint, id_banca bigint, tip string, nume string, adresa string, oras string, sector string, lat decimal(9,6), lon decimal(9,6), program string, sursa string, "
    "rating decimal(2,1), nr_recenzii int, ref_extern string, furnizori string, retea string"
)
AD = (
    "advertiser_id string, advertiser_disclosed_name string, creative_id string, format string, first_shown date, last_shown date, times_shown_lower_bound bigint, "
    "times_shown_upper_bound bigint, nr_tari int, platforme string, tintire string"
)
