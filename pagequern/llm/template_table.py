"""The labelled table the evidence classifier of templates is fitted on.

MESSAGES: sentences that stand in place of content, by language: pages not found or
moved, server errors, access and sessions, scripts and browser checks, filler and
default texts of templates.  TELLING: sentences of articles that only tell about such
things.  Written by hand; ordinary sentences come from the reference texts of the
language table.
"""

MESSAGES = {
    "en": """The page you requested could not be found.|The page you are looking for does not exist.|This page has moved or no longer exists.|The requested URL was not found on this server.|The document has moved.|Check the address or go back to the start page.|Sorry, this page is not available.|Oops, something went wrong.
        An unexpected server error occurred.|An internal error has occurred.|Please try again later.|The service is temporarily unavailable.|The site is unavailable because of maintenance.|Gateway timeout while contacting the upstream server.|Bad gateway.|503 Service Unavailable|404 Not Found|500 Internal Server Error|502 Bad Gateway|403 Forbidden|Error 404.|Error 500.|Too many requests.|You have sent too many requests.|Too many requests from this address.|Wait a minute and retry.|The request timed out.|Your request was blocked.
        Access denied.|Access to this resource is denied.|You do not have permission to view this page.|You are not authorized to open this page.|Your session has expired.|Please sign in again.|Please log in to continue.
        Please enable JavaScript to view this page.|JavaScript is disabled in your browser.|You need to enable JavaScript to run this app.|This site requires JavaScript.|This application needs scripts to run.|Please turn on cookies.|Your browser does not support scripts.|Your browser is not supported.|Checking your browser before you continue.|Checking if the connection is secure.|Verify that you are human.
        Sample text goes here.|Replace it with your own words.|This is a placeholder paragraph.|Insert your story here.|Enter your text here.|Your content goes here.|Content coming soon.|This is an example of a post.|This is your first post.|Edit or delete it, then start writing.|Default text of the template.|Lorem ipsum dolor sit amet.""",
    "de": """Die angeforderte Seite existiert nicht oder wurde verschoben.|Die gesuchte Seite konnte nicht gefunden werden.|Seite nicht gefunden.|Ein unerwarteter Fehler ist aufgetreten.|Der Dienst ist vorübergehend nicht verfügbar.|Bitte versuchen Sie es später noch einmal.|Zugriff verweigert.|Ihre Sitzung ist abgelaufen.|Bitte melden Sie sich erneut an.|Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.|JavaScript ist in Ihrem Browser deaktiviert.|Hier steht ein Beispieltext.|Hier kommt Ihr Text hin.|Fügen Sie hier Ihren Inhalt ein.|Inhalt folgt in Kürze.""",
    "fr": """La page demandée est introuvable.|La page recherchée n’existe pas ou a été déplacée.|Page introuvable.|Une erreur inattendue est survenue.|Le service est temporairement indisponible.|Veuillez réessayer plus tard.|Accès refusé.|Votre session a expiré.|Veuillez vous reconnecter.|Veuillez activer JavaScript pour afficher cette page.|JavaScript est désactivé dans votre navigateur.|Merci d’activer JavaScript.|Ceci est un texte d’exemple.|Ceci est un texte de remplissage.|Insérez votre texte ici.|Contenu à venir.|Titre de la page ici.""",
    "es": """La página solicitada no existe o se ha movido.|La página que busca no se encuentra.|Página no encontrada.|Se ha producido un error inesperado.|El servicio no está disponible en este momento.|Inténtelo de nuevo más tarde.|Acceso denegado.|Su sesión ha caducado.|Inicie sesión de nuevo.|Para ver esta página es necesario activar JavaScript.|JavaScript está desactivado en su navegador.|Active JavaScript para continuar.|Esto es un texto de relleno.|Esto es un texto de ejemplo.|Escriba aquí su texto.|Contenido próximamente.""",
    "it": """La pagina richiesta non esiste o è stata spostata.|La pagina cercata non è stata trovata.|Pagina non trovata.|Si è verificato un errore imprevisto.|Il servizio non è al momento disponibile.|Riprova più tardi.|Accesso negato.|La sessione è scaduta.|Per continuare, attiva JavaScript nel browser.|JavaScript è disattivato nel browser.|Attiva JavaScript per vedere la pagina.|Questo è un testo di esempio.|Questo è un testo segnaposto.|Inserisci qui il tuo testo.""",
    "pt": """A página solicitada não existe ou foi movida.|A página pedida não foi encontrada.|Página não encontrada.|Ocorreu um erro inesperado.|O serviço está temporariamente indisponível.|Tente novamente mais tarde.|Acesso negado.|A sua sessão expirou.|Para continuar, ative o JavaScript no navegador.|O JavaScript está desativado no seu navegador.|Ative o JavaScript para ver esta página.|Este é um texto de exemplo.|Este é um texto de preenchimento.|Escreva aqui o seu texto.""",
    "nl": """De opgevraagde pagina bestaat niet of is verplaatst.|De gevraagde pagina is niet gevonden.|Pagina niet gevonden.|Er is een onverwachte fout opgetreden.|De dienst is tijdelijk niet beschikbaar.|Probeer het later opnieuw.|Toegang geweigerd.|Uw sessie is verlopen.|Schakel JavaScript in om deze pagina te bekijken.|Zet JavaScript aan om verder te gaan.|JavaScript is uitgeschakeld in uw browser.|Dit is een voorbeeldtekst.|Hier komt uw tekst.""",
    "sv": """Sidan du sökte finns inte eller har flyttats.|Sidan kunde inte hittas.|Sidan hittades inte.|Ett oväntat fel har inträffat.|Tjänsten är tillfälligt otillgänglig.|Försök igen senare.|Åtkomst nekad.|Din session har gått ut.|Aktivera JavaScript för att se sidan.|Slå på JavaScript för att fortsätta.|JavaScript är avstängt i din webbläsare.|Detta är en exempeltext.|Skriv din text här.""",
    "tr": """Aradığınız sayfa bulunamadı.|İstenen sayfa bulunamadı veya taşındı.|Sayfa bulunamadı.|Beklenmeyen bir hata oluştu.|Hizmet geçici olarak kullanılamıyor.|Lütfen daha sonra tekrar deneyin.|Erişim engellendi.|Oturumunuzun süresi doldu.|Bu sayfayı görmek için lütfen JavaScript’i etkinleştirin.|Tarayıcınızda JavaScript kapalı.|Bu bir örnek metindir.|Metninizi buraya yazın.""",
    "ru": """Запрошенная страница не найдена или удалена.|Запрашиваемая страница не существует.|Страница не найдена.|Произошла непредвиденная ошибка.|Сервис временно недоступен.|Попробуйте ещё раз позже.|Доступ запрещён.|Время сеанса истекло.|Для работы сайта включите JavaScript.|Пожалуйста, включите JavaScript в браузере.|В вашем браузере отключён JavaScript.|Здесь будет ваш текст.|Это пример текста.|Это пример заголовка.|Введите ваш текст здесь.""",
    "zh": """您访问的页面不存在或已被删除。|您请求的页面不存在。|页面不存在。|找不到该页面。|发生意外错误。|服务暂时不可用。|请稍后再试。|拒绝访问。|您的会话已过期。|请启用 JavaScript 以查看本页面。|请启用JavaScript。|您的浏览器已禁用 JavaScript。|这里是示例文字。|此处为占位文字。|请在此输入内容。""",
    "ja": """お探しのページは見つかりませんでした。|お探しのページは移動または削除されました。|ページが見つかりません。|予期しないエラーが発生しました。|サービスは一時的に利用できません。|しばらくしてから再度お試しください。|アクセスが拒否されました。|セッションの有効期限が切れました。|このページを表示するにはJavaScriptを有効にしてください。|JavaScriptを有効にしてください。|ここにテキストを入力してください。|これはサンプルテキストです。""",
    "hi": """आपके द्वारा खोजा गया पृष्ठ नहीं मिला।|अनुरोधित पृष्ठ मौजूद नहीं है या हटा दिया गया है।|पृष्ठ नहीं मिला।|एक अनपेक्षित त्रुटि हुई।|सेवा अस्थायी रूप से उपलब्ध नहीं है।|कृपया बाद में पुनः प्रयास करें।|पहुँच अस्वीकृत।|आपका सत्र समाप्त हो गया है।|कृपया JavaScript सक्षम करें।|इस पृष्ठ को देखने के लिए JavaScript चालू करें।|यह एक नमूना पाठ है।""",
    "th": """ไม่พบหน้าที่คุณต้องการ|ไม่พบหน้าเว็บ|เกิดข้อผิดพลาดที่ไม่คาดคิด|บริการไม่พร้อมใช้งานชั่วคราว|โปรดลองอีกครั้งในภายหลัง|ปฏิเสธการเข้าถึง|เซสชันของคุณหมดอายุ|กรุณาเปิดใช้งาน JavaScript เพื่อดูหน้านี้|โปรดเปิด JavaScript|นี่คือข้อความตัวอย่าง""",
}
TELLING = """Old machines ran for years without scripts.|Her evening class teaches JavaScript to beginners.|The talk was about why JavaScript pages took so long to load.|They wrote the game without JavaScript.|The old printer sets the words lorem ipsum on every poster.|Page 404 of the ledger is lost.|An error in the bus timetable confused the passengers.|Access to the tower is denied after the storm.|The council denied access to the hall.|She wrote a page about an error of the server at the inn.|The museum explains why sites ask visitors to enable JavaScript.|The message “page not found” became a joke in the town.
    He said that the service was unavailable during the storm.|The lecture is about cookies and scripts in browsers.|The page that was missing from the archive was found behind the shelf.|The session of the council expired at midnight.|The placeholder for the prize was a wooden spoon.|Our sample of the water was lost on the way.|You must be logged in to leave a comment.|Subscribe to our free newsletter and never miss a story.|We use cookies to improve your visit.|Accept all or change your settings.|By continuing to browse you agree to our privacy policy.|Share this page with your friends.|All rights reserved.|This site stores small files on your device for statistics.
    Die Seite 404 des Buches fehlt.|Ein Fehler im Fahrplan verwirrte die Reisenden.|Sie müssen angemeldet sein, um zu kommentieren.|Diese Seite mit Freunden teilen.|Abonnieren Sie den kostenlosen Rundbrief.|Wir verwenden Cookies, um Ihren Besuch zu verbessern.|Une erreur dans l’horaire a surpris les voyageurs.|Vous devez être connecté pour commenter.|Partager cette page avec vos amis.|Abonnez-vous à notre lettre gratuite.|En poursuivant, vous acceptez notre politique.
    Un error en el horario confundió a los viajeros.|Debe iniciar sesión para comentar.|Compartir esta página con sus amigos.|Suscríbase a nuestro boletín gratuito.|Si continúa navegando, acepta nuestra política de privacidad.|Un errore nell’orario ha confuso i viaggiatori.|Devi accedere per commentare.|Iscriviti alla lettera gratuita.|Um erro no horário confundiu os passageiros.|Este sítio guarda pequenos ficheiros no seu aparelho para fins estatísticos.|Een fout in de dienstregeling verwarde de reizigers.|U moet ingelogd zijn om te reageren.|Deze pagina delen met vrienden.
    Ett fel i tidtabellen förvirrade resenärerna.|Du måste vara inloggad för att kommentera.|Prenumerera på vårt gratis nyhetsbrev.|Tarifedeki bir hata yolcuları şaşırttı.|Yorum yapmak için giriş yapmalısınız.|Ошибка в расписании сбила пассажиров с толку.|Подпишитесь на бесплатную рассылку.|Мы используем файлы cookie, чтобы улучшить сайт.|时刻表上的一个错误让乘客感到困惑。|您必须登录才能发表评论。|時刻表の誤りが乗客を混乱させた。|コメントするにはログインが必要です。|समय सारणी में एक त्रुटि ने यात्रियों को भ्रमित किया।|टिप्पणी करने के लिए लॉग इन करें।|ความผิดพลาดในตารางเวลาทำให้ผู้โดยสารสับสน|คุณต้องเข้าสู่ระบบเพื่อแสดงความคิดเห็น"""


def split(text: str) -> list[str]:
    return [s.strip() for s in text.replace("\n", "|").split("|") if s.strip()]


# Short lines of menus and boxes, which are no messages either.
MENUS = r"""Contact|Contacto|Contactos|Contatti|Contato|Kontakt|İletişim|Контакты|联系我们|お問い合わせ|संपर्क|ติดต่อ|Weather|Wetter|Météo|El tiempo|Meteo|Tempo|Het weer|Väder|Hava durumu|Погода|天气|天気|मौसम|สภาพอากาศ|Log in|Sign up|Anmelden|Connexion|Entrar|Acceder|Accedi|Inloggen|Logga in|Giriş|Войти|登录|ログイン|लॉग इन|เข้าสู่ระบบ
    Home|Front page|Startseite|Accueil|Inicio|Pagina iniziale|Página inicial|Voorpagina|Startsida|Ana sayfa|Главная|首页|ホーム|मुखपृष्ठ|หน้าแรก|News|Nachrichten|Actualités|Noticias|Notizie|Notícias|Nieuws|Nyheter|Haberler|Новости|新闻|ニュース|समाचार|ข่าว|Sports|Sport|Deportes|Esportes|Spor|Спорт|体育|スポーツ|खेल|กีฬา|Culture|Kultur|Cultura|Cultuur|Kültür|Культура|文化|संस्कृति|วัฒนธรรม
    Archive|Archiv|Archives|Archivo|Archivio|Arquivo|Archief|Arkiv|Arşiv|Архив|存档|アーカイブ|संग्रह|คลัง|About us|Über uns|Qui sommes-nous|Quiénes somos|Chi siamo|Sobre nós|Over ons|Om oss|Hakkımızda|О нас|关于我们|会社案内|हमारे बारे में|เกี่ยวกับเรา|Shop|Boutique|Tienda|Negozio|Loja|Winkel|Butik|Mağaza|Магазин|商店|ショップ|दुकान|ร้านค้า|Advertisement|Anzeige|Publicité|Publicidad|Pubblicità|Publicidade|Advertentie|Annons|Reklam|Реклама|广告|広告|विज्ञापन|โฆษณา
    Related stories|Most read|You may also like|Auch interessant|Meistgelesen|Les plus lus|À lire aussi|Te puede interesar|Lo más leído|Ti potrebbe interessare|I più letti|Mais lidas|Veja também|Meest gelezen|Lees ook|Mest lästa|Läs också|En çok okunanlar|İlginizi çekebilir|Читайте также|Самое читаемое|相关阅读|最多阅读|関連記事|よく読まれている記事|संबंधित खबरें|सबसे ज्यादा पढ़ा गया|ข่าวที่เกี่ยวข้อง|อ่านมากที่สุด
    Accept all or change your settings.|Alle akzeptieren oder Einstellungen ändern.|Tout accepter ou modifier les réglages.|Aceptar todo o cambiar la configuración.|Accetta tutto o modifica le impostazioni.|Aceitar tudo ou alterar as definições.|Accepteer alles of wijzig uw instellingen.|Godkänn alla eller ändra inställningar.|Tümünü kabul et veya ayarları değiştir.|Принять все или изменить настройки.|全部接受或更改设置。|すべて許可するか設定を変更してください。|सभी स्वीकार करें या सेटिंग बदलें।|ยอมรับทั้งหมดหรือเปลี่ยนการตั้งค่า
    無料のニュースレターに登録してください。|订阅我们的免费通讯。|Ücretsiz bültenimize abone olun.|Schrijf u in voor de gratis nieuwsbrief.|Assine a nossa carta gratuita.|निःशुल्क समाचार पत्र की सदस्यता लें।|สมัครรับจดหมายข่าวฟรี|Imprint, privacy, terms of use.|Impressum, Datenschutz.|Aviso legal, privacidad.|Mentions légales.|1.|2.|§ 3.|OK|✓|×|→|Dr.|No.|p. 12|10:30|x = 1|\\textbf{bold}|== History ==|[[town]]|© 2024 The Daily.|© 2023 Anzeiger Online.|© 2025 Le Courrier.|![a view](/img/a.jpg)|[a link](https://a.example/b)|**bold** word|\\emph{soft}|said Ann.|zei Anna.|dit Anne."""
