"""The concepts of services: ordered patterns, the first match wins."""

from __future__ import annotations

# A standing order, by its name or its section.
STANDING_ORDER = r"standing\s+order|plat[ăa]\s+programat|ordin\w*\s+programat"
# Concepts of services, in order.
CONCEPTS = (
    ("alerta_sms", r"^(?!\W*(?:anular|modificar|stornar|dezactivar))[^.]{0,50}?\bSMS\b|\bBCR\s+Alert(?![^\W\d_])"),
    ("tranzactie_gambling", r"^(?![^.]*\bexcep[țt])[^.]*(?:gambling|jocuri\w*\s+de\s+noroc)"),
    ("notificare_push", r"notific\w*\s+(?:de\s+tip\s+)?push|\bpush\s+notific|^\W*push\b"),
    ("notificare_email", r"(?:notific|alert)\w*\s+(?:prin\s+)?e-?mail|alerte\b[^.]{0,40}prin\s+e-?mail"),
    ("acces_lounge", r"\blounge"),
    ("caseta_valori", r"^[^.]{0,40}?(?:\bcaset[ăaei]|\bseif\b)|p[ăa]str\w*[^.]{0,20}obiect\w*[^.]{0,30}valoare|\d+(?:[,.]\d+)?\s*[x*×]\s*\d+(?:[,.]\d+)?\s*[x*×]\s*\d+(?:[,.]\d+)?\s*mm\b"),
    ("card_pierdut_furat", r"raport\w*[^.]{0,50}(?:pierdut|furat)|plat[ăa]\s+virtual[ăa]\s+unic|virtual\s+concierge"),
    ("miniextras_atm", r"mini[\s-]*extras|list\w*\s+(?:cu\s+)?(?:a\s+)?ultimel\w*\s+\d+"),
    ("reemitere_card", r"(reemiter|re-emiter|re[îi]n?noir|[îi]nlocuir|(?<!extras\s)duplicat|refacer)\w*[^.]{0,30}card|card(?:(?!emiter)[^.]){0,30}(reemiter|re[îi]n?noir|[îi]nlocuir)"),
    ("emitere_card", r"(emiter|furnizar|eliberar)\w*[^.]{0,30}card|card[^.]{0,25}(emiter|furnizar)|emiter\w*\s+plastic|^\W*furnizar\w*\s*\(\s*emiter\w*\s*\)\s*(?:,|$)"),
    ("livrare_card", r"(livrar|trimiter|transmiter|curierat)\w*[^.]{0,30}card|card[^.]{0,25}livrar"),
    ("curierat_posta", r"^\W*(?:comision\s+|tax[ăa]\s+|cost\s+)?(?:coresponden[țţ]|corespondent[ăa]\b|curierat|curier\b|fax\b)|\b(?:DHL|TNT|UPS)\b|remiter\w*\s+prin\s+curier|^\W*scrisoare\s*$|^\W*sending\s+documents?\s+(?:through|by)\s+fax|^\W*transmiter\w*\s+(?:documente|coresponden\w*)[^.]{0,30}prin\s+(?:fax|po[șs]t|curier)"),
    ("blocare_card", r"blocar\w*[^.]{0,30}card|card[^.]{0,25}blocar|blocare\s+(a\s+)?cardului"),
    ("inchidere_card", r"[îi]nchider\w*\s+(?:a\s+)?card"),
    ("terminal_pos", r"chiri\w*[^.]{0,25}(?:terminal|\bE?POS\b)|menten\w*\s+(?:a\s+)?(?:terminal|\bE?POS\b)|instal\w*[^.]{0,30}(?:terminal|\bE?POS\b)"),
    ("administrare_banking_distanta", r"menten\w+[^.]{0,40}(?:internet|electronic|e-?)\s*banking|^\W*internet\s*banking\b[^.]{0,10}[•\-–]\s*administrar"),
    ("administrare_credit", r"^\W*(?:comision\w*\s+)?(?:\(flat\)\s+)?(?:lunar\w*\s+|anual\w*\s+)?(?:de\s+|pentru\s+)?administrar\w*\s+(?:a\s+)?(?:credit(?:ului|e|elor)?\b|DAC\b|lini\w*\s+de\s+credit|descoperit\w*|[îi]mprumut)"),
    ("administrare_card", r"administrar\w*[^.]{0,30}card|card[^.]{0,25}administrar|menten[ăa]n[țt][ăa]|ta?x[ăa]\s+anual[ăa][^.]{0,20}card|administrar\w*[^.]{0,30}\b(?:principal|suplimentar)\b|^\W*(?:•\s*)?card\w*\s+(?:adi[țt]ional\w*\s+|suplimentar\w*\s+)?(?:de\s+debit\s+)?(?:Visa|Mastercard|Maestro)\b[^.;:]{0,40}$"),
    ("schimbare_pin", r"^(?!\W*interog)[^\n]*?\bPIN\b"),
    ("tranzactie_card", r"cump[ăa]rar\w*[^.]{0,25}(bunuri|servicii)|cump[ăa]r[ăa]tur\w*\s+la\s+comercian|tranzac[țt]i\w*\s+(na[țt]ional|interna[țt]ional|quasi)|comisioan\w*\s+tranzac|tranzac[țt]ion\w*\s+comercian|opera[țt]iun\w*\s+(?:bancare\s+)?la\s+comercian\w*\s+din|pl[ăa][țt]i\s+(?:la\s+)?E?POS\b|comision\w*\s+tranzac[țt]ional\w*[^.]{0,30}\bE?POS\b|tranzac[țt]i\w*\s+comercial"),
    ("depunere_moneda", r"depuner\w*\s+(?:de\s+)?moned|num[ăa]r[ăa]r\w*[^.]{0,15}moned|^(?![^.]*inclusiv\s+moned)[^.]*\bmoned[ăa]\s+metalic"),
    ("neridicare_numerar", r"neridic|neretras|programat\w*\s+(?:[șs]i\s+)?(?:neonorat|neretras)"),
    ("retragere_numerar", r"(retrager|eliber[ăa]r|ridicar|utilizar)\w*[^.]{0,40}numerar|numerar[^.]{0,20}(retrager|eliberar)|^\W*(?:comision\s+|cost\s+)?utilizar\w*\s+(?:\(\w+\)\s+)?(?:a\s+)?ATM(?![^.]{0,60}(?:sold|PIN))|utilizar\w*\s+mijloc\w*\s+de\s+plat[ăa]\s+(?:\(\s*card\s*\)\s+)?(?:la|prin)\s+(?:ATM|POS)|^\W*(?:comision\s+(?:de\s+)?)?retrager\w*[^.]{0,60}\b(?:ATM|ghi[șs]e|casieri)|^\W*(?:cash\s+)?withdrawals?(?![a-z])"),
    ("depunere_numerar", r"depuner\w*[^.]{0,20}numerar|alimentar\w*[^.]{0,20}numerar|^\W*(?:depunere\s*/\s*)?(?:cash\s+)?deposits?\b(?!\s+(?:account|certificat))|^\W*depuner\w*\s+(?:\w+\s+)?la\s+(?:smart\s+cashbox|MFM|ma[șs]in\w*\s+multifunc|multifunc[țt]ional|ATM)"),
    ("eliberare_document", r"adeverin[țt]|\bbonitate\b|fotocopi|scriso(?:are|ri)\s+de\s+(?:bonitate|recomand|referin[țt]|inten[țt])|scriso\w*\s+(?:de\s+)?confirm|^\W*(?:comision\s+(?:de\s+|pentru\s+)?|comis\.\s+)?(?:emiter\w*\s+|eliberar\w*\s+)?confirm\w*\s+(?:(?:de\s+|pentru\s+|a\s+)?(?:sold|audit|detalii)|(?:\w+\s+){0,2}specimen|semn[ăa]tur)|confirm\w*\s+(?:a\s+)?capital\w*\s+social|duplicat\w*\s+(?:dup[ăa]\s+)?acte|copi\w*\s+(?:de\s+)?(?:pe\s+)?document|copi[ei]\w*\s+(?:similar\s+)?(?:swift|mesaj)|^\W*eliber\w*\s+(?:de\s+)?(?:alte\s+)?adres|adres\w*\s+(?:diverse|emis)|^\W*adres[ăa]\s+(?:de\s+)?lichidar|creditworthiness\s+letter|^\W*cop(?:y|ies)\s+of\s+swift|^\W*photocop"),
    ("deschidere_cont", r"deschider\w*[^.]{0,25}(cont|depozit)|^\W*deschider\w*\s*/\s*[îi]nchider\w*\s+produs|^\W*opening\s+of\s+(?:the\s+)?account"),
    ("inchidere_cont", r"([îi]nchider|lichidar)\w*[^.]{0,25}(cont|pachet|depozit)|^\W*clos(?:ing|ure)\s+(?:of\s+)?(?:the\s+)?account"),
    ("administrare_cont", r"administrar\w*[^.]{0,25}(cont|pachet)|administrare\s+(lunar|anual)|pre[țt]\w*\s+pachet|^\s*administrar\w*\s*$|^\W*(?:comision\s+(?:de\s+)?)?pachet(?:ul)?\b(?![^.]{0,3}[•\-–])(?!\s+de\s+servicii\s+de\s+protec)|^\W*(?:•\s*)?cont(?:ul)?\s+curent\b(?![^.;:]{0,70}sold)[^.;:]{0,70}$|^\W*(?:•\s*)?cont(?:ul)?\s+de\s+economii\b(?![^.;:]{0,50}sold)[^.;:]{0,50}$|^\W*cont\s+cu\s+servicii\s+de\s+baz|gestion\w*\s+(?:a\s+)?contului|^\W*administrar\w*\s+produs\b|^\W*monthly\s+maintenance\s+of\s+(?:the\s+)?account"),
    ("extras_de_cont", r"extras\w*\s+(de\s+)?cont|extras\s+de|stare\s+financiar|extras\w*\s+(?:\w+\s+){1,2}de\s+cont|^\W*extrase\b|^\W*(?:emiter|eliberar|transmiter|furnizar)\w*\s+extras\w*\b(?![^.]{0,12}alte\s+conturi)|^\W*(?:ta?x[ăa]\s+)?extras\s+duplicat|istoric\w*\s+(?:de\s+)?(?:tranzac|cont)|^\W*statement\s+of\s+(?:the\s+)?account"),
    ("activare_banking_distanta", r"(?:re)?activar\w*\s+(?:\w+\s+){0,3}(?:online|mobile|internet|banking|monet)\b|^\W*[îi]nregistr\w*\s+utilizator|(?:instalar|[îi]nrolar|[îi]nregistrar)\w*[^.]{0,30}(?:internet|mobile|web|phone|e-?)[\s-]*banking|^\W*(?:re)?instal\w*\s+(?:multicash|internet\s*banking|mobile\s*banking|e-?banking)"),
    ("token", r"(?:[îi]nlocuir|emiter|furnizar|contravaloare)\w*[^.]{0,20}\btoken\b|\btoken\w*\s+suplimentar|^\W*(?:dispozitiv\s+)?token\b(?![-)])"),
    ("administrare_banking_distanta", r"administrar\w*[^.]{0,30}(internet|mobile|phone|e-?)\s*banking|abonament[^.]{0,25}banking|(internet|mobile)\s*banking\s*[-–]?\s*administrar|(?:acces|administrar)\w*[^.]{0,40}(?:internet\s*/\s*mobile|\bIB\s*\+\s*MB\b)|abonament\w*\s+(?:lunar\w*\s+)?(?:\w+\s+){0,2}(?:online|mobile)\b|^\W*abonament\w*(?:\s+lunar\w*)?(?:\s*\([^)]*\))?\s+[\d.\s]{0,6}\w+\s+(?:\w+\s+)?(?:online|mobile|multicash)\b|administrar\w*\s+aplica[țt]i|administrar\w*[^.]{0,40}electronic\s+banking|administrar\w*\s+monet\b|utilizar\w*\s+(?:a\s+)?serviciul\w*\s+George(?!\s*(?:Info|Bills))|^\W*(?:•\s*)?internet\s*banking\s*\(?\s*ProB@nking"),
    ("investigatie", r"^\W*(?:(?:comision|speze|tax[ăa])\w*\s+(?:\w+\s+){0,2}?)?(?:de\s+|pentru\s+)?investiga[țt]i\w*(?![^.]{0,40}(?:\bCIP\b|\bCRB\b|(?:stadiul|soarta)\s+document))|investiga[țt]\w*\s+[îi]n\s+arhiv|repar\w*[^.]{0,15}\b(?:IBAN|cod)|^\W*(?:ta?x[ăa]\w*|ta?xe|comision\w*)\s+(?:de\s+)?investigar"),
    ("documentar", r"acreditiv|incasso|scriso\w*\s+de\s+(?:garan[țt]|co[mn]fort|credit)|\bSGB\b|\baval|remiter\w*[^.]{0,25}document|avizar|negocier|discrepan[țt]|finan[țt]ar\w*\s+(?:a\s+)?comer|cesiun\w*\s+de\s+crean|^\W*(?:comision\s+(?:de\s+|pentru\s+)?)?execut\w*\s+(?:a\s+)?garan[țt]|^\W*(?:emiter\w*\s+sau\s+)?(?:prelungir|extensi)\w*\s+(?:a\s+)?valabilit|acceptar\w*\s+garan[țt]i\w*\s+de\s+credit|emiter\w*\s+garan[țt]|pre-?verificar\w*\s+(?:de\s+|a\s+)?document|m[ăa]rfur\w*\s+expediat|document\w*\s+returnat|^\W*cesion(?:are|area)\s*$|\bOPC\b(?![^.]{0,25}(?:modificar|anular))|franco\s+de\s+plat|\bscont[ăa]r\w*\s+(?:a\s+)?efect"),
    ("acceptare_carduri", r"acceptare\s+(?:la\s+plat[ăa]\s+a\s+)?cardu|comerciant\w*\s+accept"),
    ("garantare_credit", r"\bFNGCIMM\b|promisiun\w*\s+(?:de\s+)?garant"),
    ("acordare_credit", r"analiz\w*\s+(?:a\s+)?dosar(?![^.]{0,20}\bredus)|\bpu\s?nerea\s+la\s+dispozi[țt]i|acordar\w*\s+(?:a\s+)?(?:credit|plafon)"),
    ("rambursare_anticipata", r"rambursa\w*\s+anticipat|anticipat\w*\s+rambursa|ramburs\w*\s+[îi]n\s+avans"),
    ("modificare_credit", r"act\w*\s+adi[țt]ional|reesalon|re[șs]alon|schimbar\w*\s+(?:a\s+)?dat\w*\s+scaden|copl[ăa]titor|perioad\w*\s+de\s+gra[țt]ie|diminuar\w*\s+(?:a\s+)?perioad|extinder\w*\s+(?:a\s+)?perioad\w*\s+de\s+creditare|prelungir\w*\s+perioad\w*\s+de\s+utilizar|majorar\w*\s+(?:a\s+)?(?:limit\w*|lini\w*)\s+de\s+credit|[îi]nlocuir\w*\s+garan[țt]i|^\W*(?:re)?emiter\w*\s+acord|^\W*acord\s+(?:de\s+)?(?:alipir|dezmembr)|acord\w*\s+de\s+instituire|^\W*(?:eliberar|[îi]nstr[ăa]inar)\w*\s+(?:a\s+)?unui\s+bun|bun\w*\s+care\s+constituie\s+garan|^\W*eliberar\w*\s+temporar|^\W*acceptar\w*\s+[îi]n\s+garan[țt]i|servic\w*\s+(?:suplimentare\s+)?prestat\w*\s+(?:de\s+banc[ăa]\s+)?la\s+(?:cererea|solicitar)|co\s?mision\w*\s+unic\s+(?:pentru|[îi]ncasat)|^\W*comision\w*\s+(?:\(flat\)\s+)?pentru\s+credit\w*\s+[îi]n\s+sold|^\W*modificar\w*\s*/\s*prelungir\w*\s+scaden"),
    ("evaluare_garantie", r"evaluar\w*[^.]{0,30}(?:imobil|apartament|teren|\bcas[ăae]\b|garan[țt]|propriet)|raport\w*\s+(?:de\s+)?evaluar|analiz\w*\s+tehnic"),
    ("neplata_credit", r"nerambursar|neplat[ăa]\w*\s+(?:a\s+)?(?:rat|sum)|(?:rat|sum)\w*\s+restant|notific\w*[^.]{0,30}restan|credit\w*\s+restant"),
    ("inregistrare_garantie", r"\baviz(?:ul)?\s+(?:de\s+)?(?:garan[țt]|ipotec)|aviz\w*\s+de\s+stinger|(?:[îi]nscri|radier|[șs]terger|modific)\w*[^.]{0,40}\b(?:RNPM|AEGRM)\b|arhiva\s+electronic\w*\s+de\s+garan|contract\w*\s+de\s+garan[țt]i"),
    ("plata_asigurare", r"poli[țt]\w*\s+(?:de\s+)?asigur|plat[ăa]\s+poli[țt]"),
    ("asigurare_credit", r"^\W*cost\w*\s+(?:de|cu|pentru)\s+asigurar"),
    ("asigurare_card", r"prima\s+de\s+asigurare|comision\w*\s+anual\w*\s+de\s+asigurare|^\W*asigur\w*\s+(?:op[țt]ional\w*|de\s+c[ăa]l[ăa]tori)|pachet\w*\s+de\s+servicii\s+de\s+protec[țt]"),
    ("custodie_titluri", r"safekeeping|p[ăa]strar\w*\s+[îi]n\s+siguran|custodi\w*\s+(?:a\s+)?(?:titlu|instrument\w*\s+financiar|valori\s+mobiliar)|registr\w*\s+secundar|instrument\w*\s+financiar|procesar\w*\s+(?:a\s+)?gaj"),
    ("tranzactionare_titluri", r"titlu\w*\s+(?:de\s+stat|adjudecat)|pie[țt]\w*\s+(?:primar|secundar)|livrar\w*\s+(?:contra|f[ăa]r[ăa])\s+plat|\bBVB\b|\bSIBEX\b|bursa\s+de\s+valori|subscrier\w*\s*/?\s*r[ăa]scump|r[ăa]scump[ăa]r\w*[^.]{0,20}\bfond|transfer\w*\s+propr\w*\s+ac[țt]iun"),
    ("portabilitate_cont", r"portabilit|schimbar\w*\s+(?:a\s+)?cont\w*[^.]{0,30}(?:de\s+la\s+o\s+banc|prestator)"),
    ("incasare", r"[îi]ncas[ăa]r(?!\w*\s+(?:a\s+)?venit)|remiter\w*\s+(?:a\s+)?cec|\bincomings?\b"),
    ("refuz_plata", r"refuz\w*\s+(?:de\s+|la\s+)?(?:plat|cec|bilet|instrument|[îi]ncas)|contest(?:a[țt]|ar)|chargeback|\bdisput|refus\w*\s+(?:a\s+)?payment"),
    ("imputernicire", r"[îi]mputernic|ad[ăa]ug\w*\s+delegat|valabilit\w*\s+(?:a\s+)?procur|administrar\w*\s+documente\s+speciale"),
    ("verificare_semnatura", r"^\W*(?:comision\s+|tax[ăa]\s+)?verific\w*(?:\s*/\s*\w+)*\s+(?:a\s+)?(?:de\s+)?(?:specimen\w*\s+(?:de\s+)?)?semn[ăa]tur"),
    ("modificare_anulare", r"^\s*(modificar|anular|stornar)\w*|amendament\w*\s+(?:la\s+)?(?:OP\b|ordin)|^\W*change\s*/\s*revo\w*\s+(?:of\s+)?a\s+payment"),
    ("debitare_directa", r"debitar\w*\s+direct|direct\s+debit"),
    ("plata_programata", r"standing\s+order|plat[ăa]\s+programat|ordin\w*\s+programat"),
    ("speze_swift", r"speze\s+swift|mesaj\s+swift|comision\s+swift|ta?x[ăa]\s+swift|^\W*swift\s+fees?\b|notific\w*[^.]{0,30}(?:via|prin)\s+swift"),
    ("transfer_credit", r"transfer\w*\s+credit|ordin\w*\s+de\s+plat[ăa]|\bpl[ăa][țt]i\b|\bplat[ăa]\b(?!\s+(?:poli[țt]|de\s+rambursat))|transfer\w*\s+(de\s+)?bani|vira?ment|[îi]n\s+favoarea\s+clien\w*\s+altor\s+b[ăa]nci|transfer\w*\s+(?:intra|inter)bancar|transfer\w*\s+[îi]ntre\s+conturi|\btransferuri\b|tranzac[țt]i\w*\s+[îi]ntre\s+conturi|^\W*OP\b|^\W*payment\s+orders?\b|comision\w*\s+suplimentar\w*\s+(?:de\s+|pentru\s+)?urgen[țt]|data\s+(?:de\s+)?valut\w*\s+(?:today|aceea?[șs]i\s+zi|same\s+day)|^\W*comision\w*\s+(?:pentru\s+)?(?:op[țt]iunea\s+)?OUR\d*\b|\bOUR\s+garantat|^\W*comision\w*\s+transfer\w*\s+bancar\b|urgent\s+payments?|payments?\s+with\s+OUR|corresponding\s+banks?\s+fee|^\W*[<>≤≥]\s*\d[\d.,]*\s*(?:LEI|RON|EUR)\w*(?:\s+echivalent\s+euro)?\s+(?:si|și)\s+urgent"),
    ("interogare_sold", r"interog\w*[^.]{0,20}sold|verificar\w*[^.]{0,20}(sold|disponibil)|consultar\w*[^.]{0,20}sold|comunicar\w*\s+sold"),
    ("conversie_valutara", r"conversi\w*\s+valutar|schimb\w*\s+valutar|^\W*fx\s+exchange|marj\w*\s+(?:de\s+)?(?:ajustare\s+)?(?:a\s+)?curs\w*\s+valutar|valut\w*\s+efectiv\w*\s+[îi]n\s+alt\w*\s+valut"),
    ("modificare_anulare", r"(modificar|anular|stornar)\w*"),
    ("interogare_baze_date", r"\bCIP\b|\bCRB\b|\bRECOM\b|baz[ăa]\s+de\s+date|investigator\b|\bCRC\b|\bONRC\b|credit\s+bureau"),
    ("poprire", r"poprir|execut\w*\s+silit|sechestr|garnishment"),
    ("recuperare_card", r"recuper\w*[^.]{0,30}card|card[^.]{0,30}(re[țt]inut|recuper)"),
    ("file_cec", r"file\s+cec|carnet\w*\s+(?:de\s+)?cec|bilet\w*\s+la\s+ordin|\bcec\w*\s+(?:barat|in\s+alb)|formular\w*\s+de\s+cec|instrument\w*\s+(?:de\s+)?debit|\bcecuri\b|retrager\w*\s+instrument|instrument\w*\s+de\s+pe\s+circuit|\binterven[țt]iun"),
    ("alerta_sms", r"\bSMS\s*(?:alert|banking|notific)|alert[ăae]\s+(?:prin\s+)?SMS|notific[ăa]r\w*\s+(?:prin\s+)?SMS|serviciu\s+SMS|\binfo\s*SMS|serviciu\w*\s+de\s+alertar(?![^.]{0,20}George)"),
)
# What a label says before it lists its content; the account for payments, which is no payment.
CONTENT_LIST = r"(?s),?\s*(?:con[țt]in[âaȃ]nd|const[ăa]\s+[îi]n)\b.*"
PAYMENT_ACCOUNT = r"cont\w*\s+de\s+pl[ăa][țt]i"
# Labels that are a fragment by their form; notes, services that no concept names, and sentences, which are none.
FRAGMENT = r"^\s*[-–—•·▪(\[]|^\s*[<>≤≥]|^[a-zăâîșț]|^\s*(?:si|sau|de|la|in|din|pe|pentru|prin|cu)\b"
NOTE = r"^\s*(?:not[ăa]|nota\s+bene|obs|aten[țt]ie|excep[țt]|men[țt]iune)\b\s*[:.]?|^\s*[*†‡]|^\s*\d\)\s|^\s*\(\d+\)|^\s*(?:www\.|https?://)"
UNNAMED = (
    r"^\W*(?:speze\s+pentru\s+|comision\s+(?:de\s+|pentru\s+)?)?investiga[țt](?![^.]{0,40}document)"
    r"|^\W*(?:eliberare\s+)?(?:adeverin[țt]|confirm\w*\s+(?:sold|audit)|duplicat|scriso(?:are|ri)\s+de\s+(?:bonitate|recomandare|inten))"
    r"|^\W*(?:[îi]nchirier\w*\s+)?caset|^\W*curierat|schimb\w*\s+[îi]ntre\s+bancnote"
)
SENTENCE = r"\w\s*\.\s*$"
FRAGMENT_LENGTH, SENTENCE_WORDS = 28, 5
