"""Pages labelled by hand, line by line, from which the main-content model is trained.

All pages are invented. A line opens with its label: "+" belongs to the report, "-" is furniture, "=" is furniture that the site repeats on
every page. The first line of a page is its source, how it was read, and its title. HTML pages carry the labels in front of each text.
"""

PAGES = """
@ Harbour Courier | HTTP_HTML | Ferry line to Northmoor reopens after repairs
= Home
= News
= Weather
= Log in
= Home | News | Sport | Weather | Archive
= News / Weather / Sport / Archive / Jobs / Letters / My account / Contact / Puzzles / Log in
- News / Ferry line to Northmoor reopens after repairs
- By Edith Marlow, Harbour Courier correspondent
- Published: 4 March 2025, 09:12
+ The ferry between the old harbour and Northmoor took its first passengers on Tuesday after eleven weeks of repairs to the pier.
+ What the engineers found
+ Divers had discovered in December that four of the wooden piles were hollow. "We could push a hand through them," said the harbour master.
+ • Morning: three crossings until noon, with room for twelve cars on each of them.
+ • Evening: a single crossing at seven, for passengers on foot only.
+ 1. Tickets bought before the repairs stay valid until the end of June.
= The story continues below this advertisement.
+ The council will decide in May whether the night crossing returns as well.
= Read more: Storm tears roof off the fish market
= Related: Who pays for the new breakwater?
= You may also like
- » School wins prize for its weather station
- » Two hurt as lorry leaves the coast road, police say
- Tags: ferry, harbour, Northmoor
= Share this article: Facebook, X, e-mail
= Copy link
= Follow Harbour Courier on your favourite network
= We use cookies to measure how our pages are read. Accept all | Cookie settings
= Sign up for the morning letter of the Harbour Courier
= © 2025 Harbour Courier. All rights reserved.
@ Harbour Courier | BROWSER | Choir festival moves to the old brewery
= Home
= News
= Weather
= Log in
= Skip to content
- EDITH MARLOW
- CHOIR FESTIVAL MOVES TO THE OLD BREWERY
- Photo: Edith Marlow
+ The choir festival will take place in the halls of the old brewery this summer because the concert house is closed for fire safety work.
+ Organisers expect four thousand visitors on each of the three days, about as many as last year, and have hired additional buses.
+ A longer programme
+ Forty choirs from nine countries have agreed to come. "It was easier to fill the halls than to find chairs," one of the organisers said.
+ • Friday – opening: children's choirs sing in the yard from four in the afternoon.
+ Whether the festival stays there next year depends on the neighbours.
- Edith Marlow and Tom Reed contributed to this report.
= Most read
- 1. Ferry line to Northmoor reopens after repairs
- 2. Why the lighthouse went dark for a night
- 3. Harbour master: what the divers found in the pier
- 4. Two hurt as lorry leaves the coast road, police say
= Already a subscriber? Log in
= You have 3 free articles left this month.
- 214 shares
- #choir #festival #brewery
= No part of this text may be copied or redistributed without the written consent of the publisher.
= Harbour Courier is bound by the rules of the press complaints board.
= © 2025 Harbour Courier. All rights reserved.
@ Plain Gazette | PUBLISHER_RSS | Bakers ask for later opening hours
+ Bakers in the valley have asked the district to let them open two hours later on Sundays, since hardly any customers come before eight.
+ The district will answer in autumn. Until then the present rule applies, and those who break it risk a fine of up to four hundred.
+ Not all agree
+ Some of the smaller shops fear that the large chains would profit most. They want a vote among all members first.
- From the newsroom
= The post appeared first on Plain Gazette.
= Read more: Flour prices fall for the third month
@ Talbote | HTTP_HTML | Neue Brücke über die Lomm wird später fertig
= Startseite
= Politik
= Sport
= Anmelden
= Startseite | Politik | Wirtschaft | Sport | Kultur
= Startseite · Politik · Wirtschaft · Sport · Kultur · Meinung · Wetter · Stellen · Kontakt · Mein Konto
- Politik > Neue Brücke über die Lomm wird später fertig
- Von Jutta Ebers, Korrespondentin von Talbote
- Veröffentlicht am 12.05.2025
+ Die neue Brücke über die Lomm wird frühestens im November eröffnet, weil der gelieferte Stahl nicht den Vorgaben der Prüfer entsprach.
+ Streit um die Kosten
+ Das Land rechnet mit Mehrkosten von drei Millionen. „Wir zahlen nur, was vereinbart war“, sagte der Landrat am Montag vor dem Ausschuss.
+ • Umleitung: der Verkehr fließt bis dahin über die alte Furt bei Heimbach.
= Anzeige
+ Die Firma wollte sich nicht äußern.
= Mehr dazu: Warum die Furt im Winter gesperrt bleibt
= Lesen Sie auch: Bahn streicht Halt in Heimbach
= Das könnte Sie interessieren
- » Wolf in der Nähe des Freibads gesehen
- » Bahn streicht Halt in Heimbach, Pendler sind empört
= Artikel teilen: Facebook, WhatsApp, per E-Mail senden
- Schlagwörter: Brücke, Lomm, Verkehr
= Talbote nutzt Cookies. Alle akzeptieren | Datenschutz-Einstellungen
= Bereits Abonnent? Anmelden
= Jede Weitergabe dieses Textes bedarf der schriftlichen Zustimmung von Talbote.
= © 2025 Talbote. Alle Rechte vorbehalten.
@ Talbote | BROWSER | Schwimmer retten Hund aus dem Kanal
= Startseite
= Politik
= Sport
= Anmelden
- JUTTA EBERS
- Aktualisiert: 3. Juni 2025, 17:40 Uhr
- Foto: Jutta Ebers
+ Zwei Schwimmer haben am Samstag einen Hund aus dem Kanal gezogen, der seit dem Morgen auf einer Eisenleiter festgesessen hatte.
+ Die Besitzerin hatte das Tier schon überall gesucht und bedankte sich mit einem Kuchen bei allen Helfern, die am Ufer geblieben waren.
+ Wer hilft bei solchen Fällen?
+ Zuständig ist die Feuerwehr. Sie rät davon ab, selbst ins Wasser zu gehen.
= Meistgelesen
- 1. Neue Brücke über die Lomm wird später fertig
- 2. Warum die Furt im Winter gesperrt bleibt
- 3. Heimbach streitet über den Preis des Freibads
= Der Text geht unter der Anzeige weiter.
= Morgenbrief abonnieren: jeden Tag um sechs
- 58 mal geteilt
= Folgen Sie Talbote in den Netzwerken
= © 2025 Talbote. Alle Rechte vorbehalten.
@ L'Écho du Gué | HTTP_HTML | La halle aux grains sera démontée pierre par pierre
= Accueil
= Monde
= Culture
= Se connecter
= Accueil / Monde / Politique / Culture / Économie / Météo / Emploi / Contact / Mon compte
= Nos 140 partenaires et nous enregistrons des cookies sur votre appareil. Vous pouvez changer d'avis à tout moment.
- Culture › La halle aux grains sera démontée pierre par pierre
- Par Odile Marchand, correspondante de L'Écho du Gué
- Publié le 9 avril 2025 à 8 h 15
+ La halle aux grains sera démontée pierre par pierre cet été avant d'être remontée de l'autre côté de la place, a décidé le conseil.
+ Un chantier de deux ans
+ Le maire promet que le marché se tiendra pendant les travaux. « Personne ne perdra sa place », a-t-il dit aux commerçants réunis jeudi.
+ • Été : dépose du toit et des poutres, qui seront gardées dans un hangar près de la gare.
= Publicité
+ La région paiera la moitié du coût.
= À lire aussi : Le canal privé d'eau pendant trois semaines
= Vous aimerez aussi
- » Le facteur de Brive prend sa retraite après quarante ans
- 2. Le canal privé d'eau pendant trois semaines, selon le préfet
= Partager cet article : Facebook, copier le lien, envoyer par courriel
- Mots-clés : halle, place, travaux
= Ce site utilise des cookies. Tout accepter | Gérer mes cookies
= Déjà abonné ? Se connecter
= Il vous reste 2 articles gratuits ce mois-ci.
= © 2025 L'Écho du Gué. Tous droits réservés.
@ La Ribera | HTTP_HTML | El mercado de flores vuelve a la plaza
= Inicio
= Mundo
= Deportes
= Inicie sesión
= Inicio / Mundo / Deportes / Cultura / Empleo / Tiempo / Contacto / Boletines / Mi cuenta
- Mundo / El mercado de flores vuelve a la plaza
- Por Inés Calvo, corresponsal de La Ribera
- Actualizado: 18/03/2025
+ El mercado de flores vuelve el sábado a la plaza mayor, de donde había salido hace dos años por las obras del aparcamiento subterráneo.
+ Menos puestos que antes
+ Solo caben treinta puestos en lugar de cuarenta. «Nos arreglaremos», dijo la presidenta de los floristas, que esperaba un reparto por sorteo.
+ • Horario: de ocho de la mañana a dos de la tarde, también los días de fiesta.
= La noticia sigue tras la publicidad
+ El ayuntamiento pagará los toldos.
= Lea también: Cortan el agua en el barrio viejo
= Lo más leído
- 1. Un burro entra en la estación y retrasa dos trenes
- 2. Cortan el agua en el barrio viejo, dice el alcalde
= Compartir (Facebook, copiar enlace, enviar por correo)
- Etiquetas: flores, plaza, mercado
= La Ribera usa cookies. Aceptar todo | Configurar cookies
= ¿Ya es suscriptor? Inicie sesión
= Queda prohibida la copia sin permiso escrito de La Ribera.
= © 2025 La Ribera. Todos los derechos reservados.
@ Il Vado | BROWSER | La funivia riparte con due cabine in più
= Home
= Mondo
= Cultura
= Acceda
= Home | Mondo | Politica | Cultura | Economia | Meteo | Lavoro | Contatti | Cerca
- Mondo » La funivia riparte con due cabine in più
- di Paola Neri, corrispondente di Il Vado
- Pubblicato il 21 febbraio 2025
- Foto: Paola Neri
+ La funivia del monte Sarno riparte domenica con due cabine in più, dopo un inverno di lavori che hanno cambiato tutte le funi portanti.
+ Prezzi fermi
+ Il biglietto non aumenta fino a ottobre. «Vogliamo riavere i turisti», ha detto il gestore, che aveva chiuso la stagione con molte perdite.
+ • Orario: prima corsa alle sette, ultima alle ventuno, ogni venti minuti.
= Continua dopo la pubblicità
+ Il comune garantisce per il prestito.
= Leggi anche: Frana sulla strada dei mulini
= Potrebbe interessarle
- Il panettiere che sforna per i cani
= Condividi (Facebook, copia il link, invia per posta)
- Tag: funivia, Sarno, turismo
= Il Vado usa cookie. Accetta tutto | Preferenze sui cookie
= Le restano 4 articoli gratuiti questo mese.
= Vietata la riproduzione senza consenso scritto di Il Vado.
= © 2025 Il Vado. Tutti i diritti riservati.
@ Głos Brodu | HTTP_HTML | Stary młyn będzie domem kultury
= Strona główna
= Kraj
= Pogoda
= Zaloguj się
= Strona główna | Kraj | Świat | Kultura | Pogoda
= Strona główna · Kraj · Świat · Kultura · Gospodarka · Sport · Praca · Moje konto · Kontakt
- Kraj / Stary młyn będzie domem kultury
- Autor: Helena Wilk, korespondentka Głos Brodu
- Opublikowano: 7 maja 2025, 11:05
+ Stary młyn nad rzeką zostanie przebudowany na dom kultury, a pierwsze zajęcia odbędą się tam jesienią przyszłego roku, ogłosił burmistrz.
+ Skąd pieniądze
+ Połowę kosztów pokryje województwo. „Na więcej nas nie stać”, przyznała skarbniczka, która długo sprzeciwiała się temu pomysłowi.
+ • Parter: pracownia stolarska i sala dla seniorów z wejściem od podwórza.
= Reklama
+ Radni zagłosują w czerwcu.
= Czytaj także: Most zamknięty do odwołania
= Zobacz też: Kto wygrał konkurs orkiestr
= Może Cię zainteresować
- » Bocian zablokował ruch na obwodnicy
- » Most zamknięty do odwołania, mówi starosta
= Dalsza część tekstu pod reklamą.
= Udostępnij artykuł: Facebook, kopiuj link, wyślij e-mailem
- Tagi: młyn, kultura, rzeka
= Ta strona używa plików cookie. Akceptuj wszystko | Ustawienia prywatności
= Masz już abonament? Zaloguj się
= Zapisz się na poranny list redakcji
= © 2025 Głos Brodu. Wszelkie prawa zastrzeżone.
@ Голос Броду | HTTP_HTML | Стару школу перетворять на бібліотеку
= Головна
= Світ
= Погода
= Увійти
- Світ / Стару школу перетворять на бібліотеку
- Автор: Олена Гай, кореспондентка Голос Броду
- Опубліковано: 15 квітня 2025, 10:30
+ Стару школу біля річки перетворять на бібліотеку, а перші читачі зайдуть туди вже наступної осені, повідомив у понеділок міський голова.
+ Хто заплатить
+ Половину витрат покриє область. «Більше ми не маємо», визнала голова комісії, яка довго виступала проти цього задуму.
+ • Перший поверх: майстерня і зала для літніх людей із входом з подвір'я.
= Реклама
+ Депутати голосуватимуть у червні.
= Читайте також: Міст закрито до кінця місяця
= Вас може зацікавити
- » Лелека зупинив рух на об'їзній дорозі
- » Міст закрито до кінця місяця, каже староста
= Поширити статтю: копіювати посилання, у мережах
- Теги: школа, бібліотека, річка
= Сайт використовує файли cookie. Прийняти все | Налаштування приватності
= Уже маєте передплату? Увійти
= Передрук цього тексту без письмової згоди заборонено.
= © 2025 Голос Броду. Усі права захищено.
@ Речной вестник | BROWSER | Паром вернётся на линию к середине лета
= Главная
= Мир
= Погода
= Войти
- Мир › Паром вернётся на линию к середине лета
- Автор: Ольга Рябова, корреспондент Речной вестник
- Опубликовано: 2 мая 2025
- Фото: Ольга Рябова
+ Паром вернётся на линию к середине лета, потому что новый двигатель задержался на складе из-за спора о пошлинах, сообщила пристань.
+ Что будет до тех пор
+ Пассажиров перевозят два катера. «Мест хватает не всем», признал начальник пристани, обещавший добавить утренний рейс для школьников.
+ • Утро: три рейса до полудня, билеты продаются только на берегу.
= Реклама
+ Цены пока не изменятся.
= Читайте также: Набережную закроют на ремонт
= Самое читаемое
- 1. Кот вернулся домой через два года
- 2. Набережную закроют на ремонт, говорит мэр
= Поделиться статьёй: копировать ссылку, в сетях
- Темы: паром, река, лето
= Сайт использует файлы cookie. Принять все | Настройки приватности
= Уже есть подписка? Войти
= Перепечатка этого текста без письменного согласия запрещена.
= © 2025 Речной вестник. Все права защищены.
"""

HTML_PAGES = [
    """<html><body><nav><ul><li>=Home</li><li>=News</li></ul></nav><main><article><h1>-Quarry lake opens to bathers</h1><p>+The lake in the old quarry opens to bathers on the first of June, after tests had found the water clean for three years in a row.</p>
<h2>+Rules at the shore</h2><p>+Dogs and boats stay forbidden.</p><ul><li>+Parking: two hundred places at the northern gate, none at the southern one.</li></ul></article><aside class="related"><h3>=Read more: Bus line to the quarry</h3><p>-Fish stocks recover in the upper valley</p></aside></main>
<footer><p>=© 2025 Shore Paper. All rights reserved.</p></footer></body></html>""",
    """<div class="page"><div class="cookie-banner"><p>=We use cookies to measure how our pages are read.</p></div><div class="content"><p>+Carpenters have begun to rebuild the roof of the town hall that a storm tore off in February, and hope to finish before the rain sets in.</p>
<p>+The work costs less than feared.</p><blockquote>+“We kept every slate we found,” the foreman said.</blockquote></div><div class="share-bar"><ul><li>=Share this article</li><li>=Copy link</li></ul></div><div class="sidebar"><p>-Two hurt as lorry leaves the coast road</p></div></div>""",
]
