"""Labelled phrases from which the residue models are fitted: fixed values, written from general knowledge of web pages,
applications and forms, none taken from documents of a corpus.

A line is a template: ``(a|b|c)`` stands for one of its alternatives. ``phrases`` draws at most ``DRAWN`` phrases from a
template, so a kind has at most ``LIMIT`` labelled phrases, whatever the corpus; natural prose is fitted on the corpus.
"""

from __future__ import annotations

import random
import re

#: Most phrases drawn from a template, and most phrases of a kind: the bound of the labelled sample.
DRAWN = 48
LIMIT = 12_000
#: Sentences of mock Latin, the usual filler of page designs, made of syllables.
LATIN = 400
CHOICE = re.compile(r"\(([^()]*)\)")

ERRORS = r"""
(Oops|Whoops|Sorry|Oh no|Uh-oh|Hmm)(,|!|.|...) (something|that|this) (went wrong|has gone wrong|did not work|broke|failed)( on our end| at our end| on our side| with your request|).
(Something|Things) (went wrong|failed|broke) (while|when) (loading|opening|fetching|saving|processing|displaying) (this page|the page|your request|the data|the content|the image|the list).
(We|The site|The system|The application|Our servers|The server) (encountered|ran into|hit|experienced|met) (an unexpected|an internal|a technical|an unknown|a temporary) (error|problem|issue|fault|difficulty)( while processing your request| and could not complete your request| and had to stop|).
(We are|We're) (having|experiencing) (technical difficulties|trouble loading this page|trouble connecting|some problems|server issues)( right now| at the moment|).
(We are|We're) (sorry|very sorry|afraid)(,| but| that) (the page|this page|the service|the site|your request|the file) (is unavailable|could not be completed|can't be shown|does not work|failed).
(An|One) (unexpected|unknown|internal|unhandled|fatal|application|runtime) (error|exception|problem) (occurred|has occurred|was thrown|happened|was detected)( while loading the page| during the request| in the application|).
(Please|Kindly|You can|You may) (try again|try again later|reload the page|refresh the page|retry|refresh your browser|come back later|check back later|go back and try again|try once more).
(Try again|Retry|Reload|Refresh|Check back|Come back) (later|soon|in some minutes|in a moment|in an hour|in a little while|after some time|tomorrow).
(If the|If this) (problem|error|issue) (persists|continues|keeps happening), (please |)(contact|notify|inform|email|tell) (support|the administrator|the site owner|the webmaster|your administrator|the help desk|us).
(Contact|Notify|Please contact|Ask) (support|technical support|customer service|the administrator|the system administrator|the webmaster|your administrator) (for help|for assistance|for more information|with this code|if you need access|and quote this reference).
(The|Our) (administrator|support team|technical team|team|developers) (has been|have been|was) (notified|informed|alerted)( of the problem| about this error|).
(The|This|That) (page|file|document|image|photo|picture|gallery|album|video|resource|record|item|link|folder|article|post|report|content|form|entry) (could not be|cannot be|can't be|was not|couldn't be|can not be) (found|displayed|loaded|opened|shown|located|reached|retrieved|read|processed)( on this server| at this time| right now| at the moment|).
(The|This|That) (page|file|document|image|photo|gallery|album|video|resource|record|link|folder|article|report) (you requested|you asked for|you are looking for|you were looking for|you tried to open|you followed) (does not exist|was not found|is not available|cannot be found|could not be found|has moved|is gone|no longer exists).
(The|This|Your) (page|file|document|image|photo|gallery|album|video|link|folder|content|account|listing|post) (has been|was|may have been|might have been) (removed|deleted|moved|archived|renamed|disabled|suspended|blocked|taken down|withdrawn)( by its owner| by the author| by an administrator| or never existed| or is temporarily unavailable|).
(The|This) (page|file|document|image|photo|gallery|album|video|link|content|service|website|site|feature|resource) (is|is currently|is temporarily|is no longer|is not|isn't) (available|unavailable|accessible|offline|working|reachable|supported|active|online)( in your region| in your country| right now| at the moment| at this time|).
(The|This|Your) (link|session|token|page|request|download|invitation|login|code) (has expired|expired|is broken|is invalid|timed out|has timed out|is no longer valid|was cancelled).
(Your|The) (session|login) (has expired|has ended|timed out|is no longer valid)(. | due to inactivity. |, )(Please sign in again|Please log in again|Sign in to continue|Log in again to continue).
(You|Visitors|Guests) (do not|don't|may not) have (permission|access|the rights|sufficient privileges|the required role|authorization) to (view|access|open|see|edit|read|enter|use) (this page|this resource|this file|this folder|this document|this album|this content|this directory|the requested item)( on this server|).
(You are|You're) (not authorized|not authorised|not allowed|not permitted|forbidden|not logged in|not signed in)( to view this page| to open this file| to see this content| to access this area|).
(You must|You need to|You have to|Please) (log in|sign in|be logged in|be signed in|register|create an account|request access)( first| again|) to (view|see|access|open|continue|read) (this page|this content|the file|this album|the document|more|the site).
(Access|Permission|Entry|Authorization) (denied|forbidden|refused|is restricted|required|failed|was denied)(.|!| -|:) (You do not have access|Insufficient privileges|Invalid credentials|Your account lacks the required permission|Authentication is required).
(401|403|HTTP 401|HTTP 403|Error 401|Error 403)( -|:|) (Unauthorized|Forbidden|Access forbidden|Authentication required|Not authorized).
(404|HTTP 404|Error 404|Status 404|404 error)( -|:|.|) (Not found|Page not found|File not found|The page was not found|Nothing was found here|Resource not found|This page does not exist).
(500|502|503|504|HTTP 500|HTTP 503|Error 500|Error 502|Error 504|Status 500)( -|:|.|) (Internal server error|Bad gateway|Service unavailable|Service temporarily unavailable|Gateway timeout|Gateway time-out|The server is overloaded).
(400|405|408|409|410|413|429|Error 400|HTTP 429|HTTP 410)( -|:|.|) (Bad request|Method not allowed|Request timeout|Conflict|Gone|The resource is gone|Payload too large|Rate limit exceeded).
(Bad gateway|Service unavailable|Gateway timeout|Bad request|Not found|Forbidden|Unauthorized|Request timed out|Page not found|File not found|Network error|Database error|Fatal error|Unknown error|Syntax error|Parse error|Runtime error|Application error|Script error).
(Too many|There were too many|You have made too many) (requests|attempts|connections|redirects|login attempts)(. |, )(please slow down|please wait before trying again|wait a moment|your address was blocked for a while|try again later).
(The|Our) (server|service|site|database|host|system|portal|backend|proxy) (is|is currently|is temporarily) (down|offline|busy|overloaded|unavailable|unreachable|not responding|under maintenance|undergoing maintenance|closed for maintenance|too busy).
(The|Our) (server|host|remote host|upstream server|database|proxy|gateway|service) (did not respond|is not responding|took too long to respond|refused the connection|closed the connection|returned an error|returned an invalid response|timed out|failed to answer).
(Connection|The connection|The network connection) (refused|timed out|was reset|was closed|was interrupted|was lost|failed|to the server was lost|reset by peer|to the database failed|could not be established).
(Could not|Cannot|Can't|Unable to|Failed to|We could not|We couldn't|We can't|We were unable to) (connect to|reach|contact|load|open|read|find|fetch|retrieve|display|process|save|upload|download|access|resolve) (the server|the database|the host|the page|the file|the image|the images|the data|the list|the resource|the requested page|your request|your files|the album|this content|the record|the network).
(Failed|Unable) to (load|fetch|render|parse|open) (resource|image|thumbnail|preview|script|stylesheet|data|response|module|chunk|component)(: | - |, )(net::ERR_CONNECTION_REFUSED|net::ERR_FAILED|the server responded with a status of 404|the server responded with status 500|timeout|network error|invalid JSON).
(Please |)(check|verify) (your internet connection|your network settings|your connection|the address|the URL|the spelling of the address|your firewall|that you typed the address correctly) and (try again|reload|refresh the page|retry).
(No|There is no|There was no) (internet connection|network connection|connection to the server|connection to the database|response from the server|such file or directory|such page|data to display|preview available|results|results found|matching records|image available).
(Nothing|No page|No content|No file|No entry) (was found|could be found|exists|is available) (at this address|at this location|here|under this name|for your query)(. Try a search| . Perhaps searching will help|.|. Go back to the home page).
(The|This) (site|page|service|system|portal|database) is (under|undergoing|closed for|down for|offline for) (maintenance|scheduled maintenance|planned maintenance|routine maintenance|repair|an upgrade)(. We will be back shortly|. Please come back later|. Thank you for your patience|.).
(Scheduled|Planned|Emergency|Routine) maintenance (is in progress|in progress|is under way|window)(. | - )(Service will resume shortly|We will be back soon|The service returns at 0:00|Please be patient).
(Upload|Download|Export|Import|Login|Payment|Submission|Search|Sync|Request) (failed|was rejected|was cancelled|timed out|could not be completed)(: | because |. )(the file is too large|invalid file type|the server refused the connection|unknown reason|the token is invalid|disk full|quota exceeded).
(Invalid|Missing|Unknown|Malformed|Unexpected) (request|token|parameter|session|credentials|password|username|API key|argument|response|character|column|file format|input|certificate|CSRF token).
(Warning|Notice|Fatal error|Parse error|Deprecated|Error): (undefined index|undefined variable|uncaught exception|call to undefined function|division by zero|include(file.php) failed to open stream|syntax error, unexpected end of file|allowed memory size exhausted|cannot modify header information) in /(var|srv|home|usr)/(www|html|app|site)/(index|show|view|main|config).php on line (0|00|000).
Traceback (most recent call last): File "(main|views|server|handler|worker|models).py", line (0|00|000), in (run|load|get|main|handle|render) (KeyError|ValueError|TypeError|IndexError|TimeoutError|ConnectionError|FileNotFoundError|AttributeError): (key not found|invalid literal|list index out of range|timed out|no such file or directory|object has no attribute|none).
(java.lang|java.io|javax.servlet|org.hibernate|System).(NullPointerException|IllegalStateException|IOException|ServletException|OutOfMemoryError|RuntimeException): (null|stream closed|cannot invoke method|request failed) at (com|org|net).(app|example|web|service).(Main|Handler|Controller|Servlet).(run|doGet|handle|invoke)(Main.java:00|Handler.java:000).
(Uncaught|Unhandled) (TypeError|ReferenceError|SyntaxError|RangeError|promise rejection|exception): (cannot read properties of undefined|cannot read property of null|x is not defined|x is not a function|unexpected token|undefined is not an object|failed to fetch).
(undefined|null|NaN|[object Object]|None|N/A) (undefined|null|NaN|[object Object]|None|N/A) (undefined|null|NaN|[object Object]|None)
{"(error|status|message|code|detail)": ("not found"|404|500|"internal error"|"unauthorized"|null|false), "(message|detail|trace|code|reason|path)": ("not found"|"invalid token"|"timeout"|"forbidden"|"server error"|0|null)}
<(h1|title|h2|p)>(404 Not Found|403 Forbidden|500 Internal Server Error|502 Bad Gateway|503 Service Unavailable|Error|Server Error)</(h1|title|h2|p)>
<(Error|error)><(Code|code)>(AccessDenied|NoSuchKey|NotFound|InternalError|ExpiredToken)</(Code|code)><(Message|message)>(Access denied|The specified key does not exist|Request has expired|Internal error)</(Message|message)>
(Loading|Please wait|Loading data|Loading content|Loading images)(...| ...|, please wait| failed| error| timed out)
(Error|Reference|Incident|Request|Trace|Ray|Event) (code|ID|id|number)(: |# | )(0000|E-000|0000000|ERR_0000|x00-0000)
(SQLSTATE|ORA|MySQL|PostgreSQL|Database) (error|exception|failure)?: (connection refused|too many connections|table does not exist|syntax error near|deadlock detected|lost connection to server during query)
(The|This|Your) (browser|connection|certificate|request|query|file|image|archive) (is corrupt|is corrupted|is not secure|is not valid|contains errors|was blocked|cannot be verified|is empty).
(Broken|Missing|Damaged|Corrupt) (image|link|file|page|thumbnail|attachment)
(Image|Photo|Picture|Video|Preview|Thumbnail|Map|Content) (not available|unavailable|could not be loaded|failed to load|cannot be shown|missing)
(Go back|Return|Back) to (the home page|the homepage|the previous page|the start page|the main page|the index|safety) (or|and) (try a search|use the search box|contact us|try again|start over).
(You have|You've) (exceeded|reached|used up) (your quota|the limit|the maximum number of requests|your daily limit|the download limit|your storage).
(This|The) (request|address|IP address|account|user) (has been|was) (blocked|banned|rejected|flagged|limited)( by the firewall| for security reasons| by the security rules|).
(Xin lỗi|Rất tiếc|Ôi|Thành thật xin lỗi)(,|!|.) (đã có lỗi|đã xảy ra lỗi|có sự cố|trang này không tồn tại|trang không khả dụng|chúng tôi gặp sự cố|yêu cầu không thực hiện được)( xảy ra|).
(Đã xảy ra|Đã có|Có|Gặp|Phát sinh) (lỗi|sự cố|lỗi hệ thống|lỗi không xác định|lỗi kết nối|trục trặc|lỗi máy chủ)( khi tải trang| khi xử lý yêu cầu| trong quá trình tải dữ liệu| với máy chủ| trên hệ thống|).
(Vui lòng|Xin|Hãy|Bạn hãy|Xin vui lòng) (thử lại|thử lại sau|tải lại trang|quay lại sau|thử lại sau ít phút|làm mới trang|kiểm tra kết nối mạng|liên hệ quản trị viên|liên hệ bộ phận hỗ trợ|đăng nhập lại|chờ trong giây lát)( rồi thử lại| sau vài phút|).
(Trang|Tệp|Tập tin|Hình ảnh|Ảnh|Bài viết|Liên kết|Tài liệu|Album|Nội dung|Thư mục|Video|Bản ghi|Đường dẫn) (bạn tìm|bạn yêu cầu|này|bạn đang tìm|bạn muốn mở|được yêu cầu) (không tồn tại|không tìm thấy|không còn tồn tại|không khả dụng|đã bị xóa|đã bị gỡ|đã hết hạn|không còn hoạt động|đã được di chuyển|không thể mở|không thể hiển thị|tạm thời không truy cập được)( hoặc đã bị xóa| trên máy chủ| trên hệ thống này|).
(Không|Không thể|Chưa thể) (tìm thấy|tải|mở|kết nối|truy cập|hiển thị|đọc|tải được|kết nối được|lưu) (trang|tệp|máy chủ|hình ảnh|ảnh|dữ liệu|danh sách ảnh|nội dung|cơ sở dữ liệu|trang yêu cầu|tới máy chủ|đến cơ sở dữ liệu|thư mục|album).
(Bạn|Tài khoản của bạn|Người dùng) (không có quyền|chưa có quyền|không đủ quyền|không được phép|chưa đăng nhập|cần đăng nhập|phải đăng nhập|cần được cấp quyền) (truy cập|xem|mở|chỉnh sửa|để xem|để tiếp tục|để mở) (trang này|nội dung này|tệp này|thư mục này|tài liệu này|album này).
(Máy chủ|Hệ thống|Dịch vụ|Trang web|Cơ sở dữ liệu|Cổng thông tin) (đang bảo trì|đang quá tải|không phản hồi|tạm ngừng hoạt động|đang bận|tạm thời gián đoạn|không hoạt động|gặp sự cố|đang gặp lỗi|bị gián đoạn)(, vui lòng quay lại sau|, xin thử lại sau|. Mong bạn thông cảm|.).
(Lỗi|Mã lỗi) (404|500|502|503|403|400|kết nối|máy chủ|hệ thống|nội bộ|không xác định|truy cập)(: |. | - )(không tìm thấy trang|lỗi máy chủ nội bộ|dịch vụ không khả dụng|truy cập bị từ chối|hết thời gian chờ|yêu cầu không hợp lệ|vui lòng thử lại).
(Phiên|Phiên đăng nhập|Phiên làm việc|Liên kết|Mã xác nhận) (đã hết hạn|của bạn đã hết hạn|đã kết thúc|không hợp lệ|không còn hiệu lực)(. Vui lòng đăng nhập lại|, hãy đăng nhập lại|.).
(Kết nối|Yêu cầu|Quá trình tải|Tải lên|Tải xuống) (bị từ chối|bị gián đoạn|đã hết thời gian|thất bại|không thành công|bị hủy|quá thời gian chờ)( do lỗi mạng| vì tệp quá lớn|).
(Truy cập bị từ chối|Không có kết nối mạng|Không có dữ liệu|Không có kết quả|Yêu cầu không hợp lệ|Quá nhiều yêu cầu|Đang tải|Đang tải dữ liệu|Hết thời gian chờ|Ảnh không khả dụng|Đang bảo trì hệ thống)(.|...|!)
(Lo sentimos|Lo siento|Disculpe|Vaya|Ups|Perdón)(,|!|.) (algo salió mal|algo ha fallado|se produjo un error|ha ocurrido un error|no encontramos la página|esta página no existe|no podemos mostrar el contenido|hubo un problema).
(Se produjo|Se ha producido|Ocurrió|Ha ocurrido|Hubo|Hemos tenido) un (error|problema|fallo|error inesperado|error interno|error desconocido|problema técnico|error de conexión)( al cargar la página| al procesar su solicitud| en el servidor| al abrir el archivo| con la base de datos|).
(Por favor,|Le rogamos que|Puede|) (inténtelo de nuevo|intente de nuevo|inténtelo más tarde|vuelva a intentarlo|recargue la página|actualice la página|vuelva más tarde|pruebe otra vez|espere unos minutos|póngase en contacto con el administrador|contacte con soporte|inicie sesión de nuevo)( en unos minutos| más tarde|).
(La página|El archivo|La imagen|La foto|El documento|El enlace|El álbum|La galería|El recurso|El contenido|La carpeta|El registro|El vídeo) (que busca|solicitado|solicitada|que ha pedido|que intenta abrir|) (no existe|no se encontró|no se ha encontrado|no está disponible|ha sido eliminado|ha sido eliminada|fue retirado|ya no existe|ha caducado|ya no funciona|ha cambiado de dirección|no se puede mostrar|no se pudo cargar|no se pudo abrir).
(No se pudo|No se puede|No fue posible|No ha sido posible|No hemos podido|No podemos) (cargar|abrir|encontrar|mostrar|conectar con|acceder a|leer|completar|procesar|descargar|guardar) (la página|el archivo|la imagen|el servidor|la base de datos|los datos|la lista|su solicitud|el contenido|el álbum|las imágenes).
(No tiene|Usted no tiene|Su cuenta no tiene) (permiso|permisos|permisos suficientes|acceso|autorización) para (ver|abrir|acceder a|editar|entrar en|consultar) (esta página|este archivo|esta carpeta|este contenido|este recurso|este álbum).
(Debe|Tiene que|Es necesario|Necesita) (iniciar sesión|registrarse|identificarse|solicitar acceso|entrar con su cuenta) para (ver|acceder a|continuar|abrir|leer) (esta página|el contenido|este archivo|la galería|con la lectura).
(El servidor|El servicio|El sistema|El sitio|La base de datos|El portal) (no responde|no está disponible|está en mantenimiento|está saturado|está caído|está fuera de servicio|tardó demasiado en responder|rechazó la conexión|devolvió un error|no funciona por el momento)(. Vuelva más tarde|. Inténtelo en unos minutos|.).
(Error|Código|Código de error) (404|500|502|503|403|400|interno|de servidor|de conexión|desconocido)(: |. | - )(página no encontrada|error interno del servidor|servicio no disponible|acceso denegado|puerta de enlace incorrecta|solicitud incorrecta|tiempo de espera agotado|la página no existe).
(Acceso|Acceso prohibido|Permiso|Solicitud|Conexión|Sesión) (denegado|prohibido|rechazada|restringido|caducada|interrumpida|no válida|rechazado)(.|: no tiene permisos|: inicie sesión|: compruebe su conexión).
(Su sesión|La sesión|El enlace|El código) (ha caducado|ha expirado|ha terminado|ya no es válido|venció)(. Inicie sesión de nuevo|. Vuelva a entrar|.).
(Tiempo de espera agotado|Sin conexión a internet|No hay conexión|No hay datos|Sin resultados|Demasiadas solicitudes|Cargando|Cargando datos|Página no encontrada|Imagen no disponible|Página en mantenimiento|Compruebe su conexión)(.|...|!| e inténtelo de nuevo.)
"""

NOTICES = r"""
(Please|Kindly|You must|You need to|You have to|You should|To continue,|In order to continue,) (enable|turn on|activate|switch on|allow) (JavaScript|Javascript|scripts|scripting|cookies|JavaScript and cookies|pop-ups|third-party cookies)( in your browser| in your browser settings| to view this page| to continue| to use this site| and reload| for this site| to see the content|).
(JavaScript|Javascript|Scripting|JS) (is|seems to be|appears to be|is currently|has been) (disabled|turned off|switched off|blocked|not enabled|not available|not supported)( in your browser| on your device| on this browser|).
(This|The|Our) (site|website|page|application|app|portal|gallery|viewer|form|service|album|shop) (requires|needs|uses|depends on|relies on|works only with|does not work without|will not work without|cannot run without) (JavaScript|scripts|cookies|JavaScript to be enabled|a modern browser|JavaScript and cookies|scripting|an up-to-date browser)( to work properly| to function| to display its content|).
(Without|With) (JavaScript|scripts|cookies) (enabled|disabled|turned off|), (some|many|most|the) (features|parts of this page|functions|images|content) (will not work|may not work|cannot be shown|are not available|are limited).
(Your|This) browser (does not support|doesn't support|has disabled|is blocking|blocks|has blocked|does not accept) (JavaScript|cookies|scripts|this feature|HTML5|video playback|iframes|frames|WebGL|this page).
(Your|This|The) browser (is outdated|is out of date|is not supported|is no longer supported|is too old|is unsupported|needs to be updated)(. | - |, )(please upgrade|update it to continue|switch to a recent version|use a current browser|please use Chrome or Firefox).
(We|This site|This website|Our website|The site|Our partners) (use|uses|stores|places|set) (cookies|cookies and similar technologies|essential cookies|tracking cookies|third-party cookies|necessary and optional cookies) (to improve your experience|to personalise content|to analyse traffic|on your device|to remember your preferences|for analytics|to give you the best experience|to offer you a better service|to keep you signed in).
By (continuing to browse|using this site|clicking accept|continuing|visiting this website|closing this banner|staying on this page)(,| you) (you agree to|you accept|agree to|consent to|accept) (our use of cookies|the use of cookies|our cookie policy|the storing of cookies|our privacy policy|the terms).
(Accept|Reject|Allow|Decline|Manage|Customise|Confirm) (all cookies|the cookies|all|only necessary cookies|essential cookies|cookie settings|preferences|my choices|non-essential cookies)( and continue| and close|)
(Cookie|Privacy|Consent) (settings|preferences|policy|notice|banner|consent)(:|.| -) (Accept all|Reject all|Manage settings|Learn more|Read more|Save my choices)
(Cookies|Third-party cookies) (are|must be|have to be|need to be|seem to be) (disabled|enabled|blocked|turned on|allowed|accepted|required)( in your browser| to sign in| to use this page| for the login|).
(Checking|Verifying|Validating|Inspecting|Testing) (your browser|your connection|that you are human|you are not a robot|if the site connection is secure|your device|the security of your connection)( before accessing the site| before you proceed|, please wait|. This may take a few seconds|.|...).
(Please|Kindly) (wait|stand by|hold on|be patient) (while|as|until) (we|our system|the site) (check|checks|verify|verifies|are checking|validates|review) (your browser|your connection|your request|that you are not a robot|that you are a person).
(Just|One|Wait) (a moment|moment|a second|a few seconds)(...|, please|.| -) (we are checking your browser|you will be redirected|redirecting|verifying you are human|this page will reload).
(You will be|You are being|You'll be) (redirected|forwarded|taken) (to the page|shortly|automatically|in a few seconds|to the requested content|once the check is complete|after verification).
(Prove|Verify|Confirm|Show|Make sure) (that you are|you are|you're) (human|a human|not a robot|not a bot|a real person|a person|a real visitor)( by completing the action below| to continue| by solving the puzzle|).
(Complete|Solve|Pass|Answer|Finish) the (captcha|CAPTCHA|security check|challenge|puzzle|verification|test) (below|to continue|to proceed|to prove that you are human|before you can enter|to unlock the page).
(This|The) (process|check|verification) is (automatic|required|in progress|necessary|done once)(. | and )(your browser will redirect|takes only a few seconds|helps us stop automated traffic|protects us from bots|you can continue afterwards).
(Unusual|Suspicious|Automated) (traffic|activity|requests) (from your network|from your address|was detected|has been detected)(. | and )(please complete the check|we need to verify you|confirm that you are not a robot).
(Disable|Turn off|Pause|Switch off|Please disable|Please turn off) (your|the) (ad blocker|adblocker|ad blocking extension|script blocker|tracking protection|content blocker|VPN|proxy) (to continue|and reload the page|and refresh|for this site|to view the page|to support us).
(It looks like|It seems|We noticed that|We see) (you are|you're|your browser is) (using an ad blocker|blocking scripts|blocking cookies|using an old browser|in private mode|blocking advertisements).
(Adobe|The) (Flash Player|Java plug-in|PDF plug-in|viewer plug-in) is (required|needed|missing|out of date|not installed|blocked) (to view this content|to open the viewer|to play this video).
<noscript>(Please enable JavaScript|You need to enable JavaScript to run this app|This page needs JavaScript|Turn on JavaScript to see the content|JavaScript is required).</noscript>
(Allow|Enable|Unblock) (scripts|pop-ups|cookies|notifications|location access|images)( from this site| in the address bar| for this page|) (and|then|to) (reload|try again|continue|refresh the page|open the viewer).
(Vui lòng|Bạn cần|Hãy|Xin|Bạn phải|Xin vui lòng|Để tiếp tục, hãy) (bật|kích hoạt|cho phép|mở|cài đặt) (JavaScript|cookie|cookies|tập lệnh|JavaScript và cookie|cửa sổ bật lên) (để xem trang|để tiếp tục|trong trình duyệt|để sử dụng trang web này|để xem nội dung|để đăng nhập|rồi tải lại trang|trên trình duyệt của bạn).
(Trình duyệt|Trình duyệt của bạn|Thiết bị của bạn) (không hỗ trợ|đã tắt|đang chặn|chưa bật|đã chặn|không cho phép) (JavaScript|cookie|tập lệnh|tính năng này|video)(. Vui lòng bật lại|, hãy cập nhật|.).
(Trình duyệt|Phiên bản trình duyệt) (của bạn|này|) (đã cũ|đã lỗi thời|không còn được hỗ trợ|không được hỗ trợ|quá cũ)(. Vui lòng nâng cấp|, hãy cập nhật để tiếp tục|.).
(Trang web|Trang|Ứng dụng|Cổng|Trang này|Website) (này|) (cần|yêu cầu|sử dụng|dùng|chỉ hoạt động khi có|không hoạt động nếu thiếu) (JavaScript|cookie|cookies|trình duyệt mới|JavaScript và cookie)( để hoạt động| để cải thiện trải nghiệm của bạn| để ghi nhớ lựa chọn| để hiển thị nội dung| để phân tích truy cập|).
(Chúng tôi|Trang web này|Website|Hệ thống) (sử dụng|dùng|lưu) cookie (để cải thiện trải nghiệm|để cung cấp dịch vụ tốt hơn|trên thiết bị của bạn|để phân tích lưu lượng|để ghi nhớ bạn|cần thiết)(. Bạn có đồng ý không|. Bấm chấp nhận để tiếp tục|.).
(Chấp nhận|Từ chối|Đồng ý|Quản lý|Tùy chỉnh) (cookie|tất cả cookie|tất cả|cài đặt cookie|cookie không cần thiết|và tiếp tục)
Bằng việc (tiếp tục|tiếp tục sử dụng trang|truy cập trang này|nhấn đồng ý), bạn (đồng ý|chấp nhận) (với việc sử dụng cookie|chính sách cookie|điều khoản của chúng tôi|chính sách bảo mật).
(Đang|Hệ thống đang|Chúng tôi đang) (kiểm tra|xác minh|xác thực) (trình duyệt|trình duyệt của bạn|kết nối|kết nối an toàn|bạn không phải là robot|yêu cầu của bạn)(, vui lòng chờ|, xin chờ giây lát|. Quá trình này mất vài giây|...|.).
(Xác nhận|Xác minh|Chứng minh|Vui lòng xác nhận) (rằng |)bạn (không phải là robot|là người|không phải người máy|là con người|không phải là máy)( để tiếp tục|).
(Hoàn thành|Giải|Nhập) (mã captcha|bước kiểm tra bảo mật|câu đố|mã xác nhận|captcha) (bên dưới|để tiếp tục|để mở trang|để chứng minh bạn là người).
(Vui lòng|Hãy|Xin) (tắt|vô hiệu hóa|tạm dừng) (trình chặn quảng cáo|phần mềm chặn quảng cáo|trình chặn tập lệnh|tiện ích chặn) (để tiếp tục|rồi tải lại trang|cho trang này).
(Bạn sẽ được|Trang sẽ|Trang đang được) (chuyển hướng|tự động chuyển|mở sau khi kiểm tra|chuyển tới trang yêu cầu) (trong giây lát|sau vài giây|tự động).
(Active|Habilite|Debe activar|Debe habilitar|Por favor, active|Es necesario activar|Para continuar, active|Tiene que permitir|Permita) (JavaScript|las cookies|los scripts|JavaScript y las cookies|las ventanas emergentes) (en su navegador|para ver la página|para continuar|para usar este sitio|y recargue la página|para ver el contenido|para iniciar sesión|para usar la aplicación).
(JavaScript|El uso de scripts) (está|parece estar|se encuentra) (desactivado|deshabilitado|bloqueado|inactivo)( en su navegador| en este dispositivo|).
(Este|Nuestro|El) (sitio|sitio web|portal|formulario|visor) (requiere|necesita|utiliza|usa|no funciona sin|emplea) (JavaScript|cookies|cookies propias y de terceros|JavaScript para funcionar|un navegador moderno|cookies para mejorar su experiencia|cookies técnicas)( y de análisis| para mostrar el contenido| para funcionar correctamente|).
(Esta|Nuestra|La) (página|aplicación|galería|web) (requiere|necesita|utiliza|usa|no funciona sin|no se puede ver sin) (JavaScript|cookies|scripts|un navegador actualizado|JavaScript activado).
(Su|El|Este) navegador (no es compatible|está desactualizado|no admite JavaScript|ha bloqueado las cookies|no acepta cookies|es demasiado antiguo|tiene los scripts desactivados|bloquea los scripts)(. Actualícelo para continuar|. Use una versión reciente|.).
(Usamos|Utilizamos|Guardamos|Empleamos) cookies (para mejorar su experiencia|propias y de terceros|en su dispositivo|para analizar el tráfico|para recordar sus preferencias|necesarias para el funcionamiento)(. Acepte para continuar|. Más información|.).
(Aceptar|Rechazar|Configurar|Gestionar|Permitir) (cookies|todas las cookies|todo|solo las necesarias|las preferencias|cookies no esenciales)
Al (continuar navegando|usar este sitio|seguir en la página|pulsar aceptar), (acepta|usted acepta|está de acuerdo con) (el uso de cookies|nuestra política de cookies|las condiciones|la política de privacidad).
(Las cookies|Las ventanas emergentes) (están|deben estar) (desactivadas|bloqueadas|activadas|permitidas)( en su navegador| para iniciar sesión|).
(Estamos|Se está|El sistema está) (comprobando|verificando|revisando) (su navegador|su conexión|que usted no es un robot|la seguridad de la conexión)(, espere un momento|. Tardará unos segundos|...|.).
(Demuestre|Verifique|Confirme|Compruebe) que (no es un robot|es humano|es una persona|es un visitante real)( para continuar|).
(Complete|Resuelva|Supere|Responda) (el captcha|la verificación|el control de seguridad|la prueba|el desafío) (para continuar|para acceder|que aparece abajo|antes de entrar).
(Desactive|Desactive por favor|Apague|Pause) (el bloqueador de anuncios|su bloqueador|el bloqueador de scripts|la extensión) (para continuar|y recargue la página|para ver el contenido|para seguir leyendo).
(Espere|Un momento|Espere un momento|Será redirigido)(, por favor|...|,) (mientras comprobamos su navegador|será redirigido en unos segundos|la página se abrirá automáticamente|mientras verificamos su conexión).
(We|Our partners and we) (value|respect|care about) your privacy(. | - |, )(choose your settings|manage your consent|you can change your choice at any time|we need your consent|some cookies are necessary).
(Continue|Proceed|Browse|Enter) (without accepting|with necessary cookies only|after accepting|once you agree|to the site|to settings)
(This|The) (site|page|form) is protected by (reCAPTCHA|a captcha|a bot check|a firewall|an access check)( and the privacy policy applies|, please complete the check|).
(Attention required|One more step|Security check|Browser check|Bot check|Human verification|Access check|Please stand by|Almost there|Verification required)(!|.|...| | - please complete the check to continue)
(Your|The) (request|visit|browser|access) (is being|will be|must be) (checked|verified|reviewed|validated|inspected)( first| before the page opens| to keep out automated programs|).
(Turn|Switch) (JavaScript|scripts|scripting|cookies) (on|back on)( and try again| to go on| for this page| in the settings| and reload the page|).
(The|This) (content|page|viewer|image|gallery|map|table|form) (is drawn|is loaded|is shown|appears|opens|works) (with scripts|by JavaScript|only when scripts are allowed|only with JavaScript|after you accept cookies|once cookies are allowed)(, which your browser blocks|, please enable it|).
(Necessary|Functional|Analytical|Statistics|Marketing|Preference|Session) cookies (are needed|help us|remember|are always active|can be switched off|store) (for the site to work|to count visits|your language|between visits|in the settings).
(Nội dung|Trang|Biểu mẫu|Thư viện ảnh|Trình xem) (được tải|chỉ hiển thị|chỉ mở|hoạt động) (bằng JavaScript|khi bật tập lệnh|khi chấp nhận cookie|sau khi xác minh|với trình duyệt mới).
(Chúng tôi tôn trọng quyền riêng tư|Lựa chọn của bạn về cookie|Kiểm tra bảo mật|Xác minh bảo mật|Cần xác minh|Cookie cần thiết|Cookie phân tích)(. Hãy chọn cài đặt|, vui lòng hoàn tất|. Luôn bật|.|...)
(El contenido|La galería|El formulario|El mapa) (se carga|se muestra|aparece|funciona) (con JavaScript|solo si permite los scripts|al aceptar las cookies|después de la verificación)(, actívelo|.|).
(Valoramos su privacidad|Control de seguridad|Verificación necesaria|Un paso más|Cookies necesarias|Cookies analíticas|Gestione su consentimiento)(. Elija sus preferencias|, complete la prueba|. Siempre activas|.|...)
"""

FILLER = r"""
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam, eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo.
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt.
Neque porro quisquam est, qui dolorem ipsum quia dolor sit amet, consectetur, adipisci velit, sed quia non numquam eius modi tempora incidunt ut labore et dolore magnam aliquam quaerat voluptatem.
Ut enim ad minima veniam, quis nostrum exercitationem ullam corporis suscipit laboriosam, nisi ut aliquid ex ea commodi consequatur.
Quis autem vel eum iure reprehenderit qui in ea voluptate velit esse quam nihil molestiae consequatur, vel illum qui dolorem eum fugiat quo voluptas nulla pariatur.
At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores et quas molestias excepturi sint occaecati cupiditate non provident.
Similique sunt in culpa qui officia deserunt mollitia animi, id est laborum et dolorum fuga. Et harum quidem rerum facilis est et expedita distinctio.
Nam libero tempore, cum soluta nobis est eligendi optio cumque nihil impedit quo minus id quod maxime placeat facere possimus, omnis voluptas assumenda est, omnis dolor repellendus.
Temporibus autem quibusdam et aut officiis debitis aut rerum necessitatibus saepe eveniet ut et voluptates repudiandae sint et molestiae non recusandae.
Itaque earum rerum hic tenetur a sapiente delectus, ut aut reiciendis voluptatibus maiores alias consequatur aut perferendis doloribus asperiores repellat.
(Vivamus|Phasellus|Curabitur|Praesent|Vestibulum|Pellentesque|Suspendisse|Maecenas|Aliquam|Integer|Donec|Fusce|Nulla|Quisque|Morbi|Etiam|Proin|Sed) (euismod|sagittis|faucibus|tincidunt|pretium|ultrices|lacinia|consectetur|vehicula|dignissim|tempus|rhoncus|bibendum|elementum|pharetra|venenatis|laoreet|gravida) (nisl|libero|mauris|lectus|turpis|augue|sapien|purus|massa|ligula|urna|tellus|ante|justo|velit|nibh|eros|risus), (vel|sed|in|ac|eget|non|at|et|quis|id) (posuere|mattis|viverra|malesuada|porttitor|tristique|fermentum|convallis|accumsan|iaculis|condimentum|hendrerit|scelerisque|cursus|varius|blandit) (dapibus|commodo|fringilla|suscipit|interdum|vulputate|auctor|sodales|egestas|aliquet|lobortis|luctus|feugiat|imperdiet|semper|ornare).
(Cras|Nam|Ut|In|Class|Orci|Mauris|Nunc|Duis|Aenean) (mattis|aptent|hac habitasse platea|taciti sociosqu|varius natoque penatibus|quis|in faucibus|placerat|ac) (orci|dictumst|ad litora torquent|et magnis dis parturient montes|nascetur ridiculus mus|per conubia nostra|per inceptos himenaeos|luctus et ultrices posuere cubilia curae).
Li Europan lingues es membres del sam familie. Lor separat existentie es un myth. Por scientie, musica, sport etc, litot Europa usa li sam vocabular.
Far far away, behind the word mountains, far from the countries Vokalia and Consonantia, there live the blind texts.
(The|A) quick brown fox jumps over the lazy dog.
(Pack my box with five dozen liquor jugs|How vexingly quick daft zebras jump|Sphinx of black quartz, judge my vow|Jackdaws love my big sphinx of quartz).
(asdf|qwerty|qwertyuiop|asdfgh|asdf jkl|zxcv|zxcvbn|hjkl|abc abc abc|abcdefg|xxxx|xxx xxx|aaaa|blah blah blah|bla bla bla|foo bar baz|foo bar|testing 0 0 0|dummy dummy|text text text|word word word|1234567890|000 000 000)
(coming|content coming|details coming|text coming|more coming|description coming|photos coming|information coming) (soon|shortly|later)(.|!|...|)
(to be|still to be) (written|completed|announced|added|determined|confirmed|continued|defined|filled in|supplied|decided|provided)( later| soon| by the editor|)(.|...|)
(TBD|TBA|TODO|FIXME|N/A|XXX|TBC|WIP|tk tk|lipsum)( TBD| TBA| TODO| XXX|: write this| - add text|: add content|: fill in|: describe)
(This|The) (page|section|text|part|field|chapter|article|entry|paragraph|area|description|note|site) (is|is currently|is still) (empty|blank|a placeholder|under construction|being written|being prepared|in preparation|incomplete|not ready yet|not written yet|unfinished|a draft|left blank on purpose|intentionally left blank|being updated).
(This|The) (page|section|text|part|field|chapter|article|entry|paragraph|description|content|summary|note|report) (will be|is going to be|is to be|shall be) (completed|added|written|available|published|filled in|updated|supplied|provided|inserted|extended|posted)( soon| later| shortly| at a later date| in due course| next week| by the author| here| in the coming days| in the next release|).
(More|Further|Additional|Full|Detailed) (information|details|content|text|notes|pictures|data|instructions) (will be|is to be|are to be|to be) (added|provided|available|published|posted|supplied|follow)( soon| shortly| later| here| at a later time|).
(Details|Description|Text|Content|Notes|Summary|Photos|More|Information|The rest|Caption) (to follow|will follow|follows soon|to come|still missing|is missing|pending|not yet available|not available yet|coming up|goes here|needed|required).
(We are|We're|Our team is|The author is|I am|Someone is) (working on|still working on|preparing|still writing|updating|building) (this page|this section|this text|the content|it|the description)(. Check back soon|. Please come back later|. Stay tuned|.).
(We|The editor|The author|Someone|Our team|I) (will|shall|is going to|'ll) (write|add|fill in|complete|finish|post|upload|supply) (this|this part|the text|the content|more|the description|the details|this section|it) (later|soon|next week|shortly|tomorrow|when there is time|in the near future).
(Stay tuned|Watch this space|Check back soon|Come back soon|Check back later)(!|.|...| for more| for updates| for content)
(Insert|Enter|Type|Put|Add|Write|Place|Provide|Paste|Fill in|Describe) (your|the|some|a short|a brief|a|here the) (text|description|content|summary|title|notes|caption|comment|introduction|message|paragraph|details|name|story|information)( here| in this field| below| in this box| of the item| for this page|)(.|...|)
(Your|Some|The|Sample|Dummy|Example|Placeholder|Default|Body|Demo|Test|Main) (text|content|description|title|caption|paragraph|message|copy|entry|heading)( goes| here| goes here| comes here| will appear here| for layout| for testing| only|)(.|...|)
(This is|Here is|That is|It is) (a|just a|only a|some|just some) (test|sample|placeholder|dummy|demo|example|filler) (text|paragraph|entry|page|post|message|document|content)( only| and nothing else| used for layout| to be replaced| for testing purposes| that will be replaced|)(.| Please ignore.| Do not publish.| Ignore it.)
(Click|Double-click|Tap) (here|to|on this text to) (edit|edit this text|add text|enter a description|add a caption|change this paragraph|start writing|replace this text).
(Placeholder|Dummy text|Filler|Filler text|Sample content|Blank page|Under construction|No content|Empty page|Draft|Work in progress|Example only|Test page|Test entry)(.|!|, do not publish.|, please ignore.|, to be replaced.|)
(No|There is no|There are no|Nothing) (description|content|text|details|notes|information|summary|entry|data|caption)( is| are| has been| have been|) (available|provided|entered|given|added|written|supplied|here yet|yet|so far)( yet| at this time| for this item|)(.|)
(Not|Nothing) (yet written|yet available|here yet|to see here|written yet|provided|specified|filled in|entered)(.|)
(Please|Kindly|Remember to|Don't forget to) (fill in|complete|fill out|replace|add|update|remove|write) (this section|this field|this text|the form|the blank fields|the description|the placeholder|before publishing).
(Write|Describe|Explain|Summarise|List|State|Mention|Note) (here|in this section|below|in a few words|in one or two sentences) (what|how|why|the|your) (happened|you saw|it works|main points|results|findings|purpose|the item looks like|is shown|observations)(.|...)
(Nội dung|Phần này|Trang này|Mục này|Văn bản|Mô tả|Thông tin|Bài viết|Chi tiết|Ghi chú) (sẽ được|sẽ|đang được|sắp được|chờ được) (cập nhật|bổ sung|cập nhật sau|viết sau|hoàn thiện|bổ sung sau|điền sau|thêm vào|soạn thảo|đăng tải|công bố)( trong thời gian tới| sớm| sau| ở đây| trong vài ngày tới|)(.|...)
(Nội dung|Phần này|Trang này|Mục này|Văn bản|Mô tả|Thông tin|Chỗ này|Bài) (chưa có|đang trống|còn trống|để trống|chưa viết|chưa hoàn thành|chưa có nội dung|là văn bản mẫu|chỉ là chữ giữ chỗ|đang được xây dựng|đang soạn|chưa sẵn sàng)(.|, sẽ bổ sung sau.|, vui lòng quay lại sau.|)
(Nhập|Viết|Điền|Ghi|Thêm|Chèn|Dán|Gõ) (nội dung|mô tả|văn bản|tiêu đề|ghi chú|tóm tắt|thông tin|mô tả ngắn|lời giới thiệu|tên|đoạn văn) (vào đây|tại đây|ở đây|vào ô này|của bạn|của bạn ở đây|bên dưới)(.|...)
(Văn bản|Đoạn văn|Chữ|Bản|Trang|Mẫu) (mẫu|giữ chỗ|thử nghiệm|thử|nháp|ví dụ|tạm thời|minh họa)(.|, không xuất bản.|, sẽ thay sau.|, chỉ để thử.)
(Đây là|Đây chỉ là) (văn bản|đoạn văn|nội dung|trang|đoạn) (mẫu|thử nghiệm|giữ chỗ|ví dụ|tạm)(, vui lòng bỏ qua.|, sẽ được thay thế.|.)
(Sắp ra mắt|Đang cập nhật|Đang xây dựng|Đang soạn thảo|Sẽ cập nhật sau|Chưa có thông tin|Chưa có mô tả|Không có mô tả|Chưa có dữ liệu|Để trống|Còn tiếp|Đang hoàn thiện|Sẽ có sau)(.|...|!|)
(El contenido|El texto|La descripción|La información|Esta sección|Este apartado|Esta página|El resumen|Este campo|El artículo) (se añadirá|se publicará|se completará|estará disponible|será añadido|se actualizará|se escribirá|se incluirá|llegará|se redactará) (pronto|más adelante|en breve|próximamente|más tarde|en los próximos días|aquí|la semana que viene)(.|...)
(El contenido|El texto|La descripción|Esta sección|Este apartado|Esta página|El resumen|Este campo) (está|sigue|queda|todavía está|aún está) (vacío|vacía|en blanco|pendiente|en construcción|sin escribir|en preparación|incompleto|sin contenido|en obras)(.|, vuelva más tarde.|)
(Escriba|Introduzca|Inserte|Añada|Ponga|Redacte|Ingrese|Rellene) (aquí|su|el|un|una breve|el texto de) (texto|descripción|contenido|resumen|título|nombre|nota|comentario|párrafo|mensaje|presentación)( aquí| en este campo| a continuación|)(.|...)
(Texto|Contenido|Párrafo|Frase|Página|Título|Mensaje) (de relleno|de ejemplo|de prueba|provisional|de muestra|simulado|temporal|por defecto)(.|, no publicar.|, se sustituirá.|)
(Esto es|Este es|Aquí va|Aquí irá|Aquí se pondrá|Aquí vendrá) (un texto de ejemplo|un texto de prueba|el texto|la descripción|el resumen|un párrafo de relleno|su contenido|la información|el contenido)(.|...|, ignórelo.)
(Próximamente|En construcción|Muy pronto|Pendiente|Por definir|Sin descripción|Sin contenido|Más información en breve|Página en obras|Falta el texto|Falta la descripción|Pendiente de redacción|Continuará|Contenido no disponible)(.|...|!|)
(Estamos|Seguimos|El autor está) (trabajando en|preparando|redactando|escribiendo|actualizando) (esta página|esta sección|este texto|el contenido)(. Vuelva pronto|.|...)
Lorem Ipsum is simply dummy text of the printing and typesetting industry. It has been the industry's standard dummy text ever since the 1500s.
It is a long established fact that a reader will be distracted by the readable content of a page when looking at its layout.
There are many variations of passages of Lorem Ipsum available, but the majority have suffered alteration in some form, by injected humour, or randomised words.
Contrary to popular belief, Lorem Ipsum is not simply random text. It has roots in a piece of classical Latin literature.
(Bacon|Cupcake|Hipster|Pirate|Zombie|Cheese|Coffee|Office|Space) ipsum dolor (amet|sit amet) (brisket short ribs pork belly|sweet roll jelly beans|kale chips artisan|cheddar gouda brie|latte espresso crema|synergy leverage).
(The|A) (caption|summary|text|report|write-up|description|paragraph|note|story|list) (follows|will follow|comes|will appear|is posted|arrives|will be here) (after the review|after the session|once approved|when the editor is done|in the next version|when ready|after the weekend|in a few days).
(This|The) (paragraph|block|text|sentence|line) (only|merely|just) (fills|takes up|holds|reserves) (space|the space|room|a place)( on the page| for the layout| until the text is ready| for now|).
(Nobody|No one|Somebody|Someone|Anyone) (has written|has filled in|wrote|will write|should write|still has to write) (this|anything|this part|the text|the description)( yet| here| so far| later|).
(Words|Letters|Text|Sentences) (to fill|that fill|just to fill|for) (the page|the box|the space|the layout|testing)(.|, nothing more.|, ignore them.)
(Nội dung|Bài|Phần mô tả|Chú thích|Tóm tắt) (sẽ có|sẽ đến|sẽ đăng|sẽ xuất hiện|được thêm) (sau khi duyệt|sau buổi chụp|khi biên tập xong|vào tuần sau|trong phiên bản sau).
(Đoạn|Dòng|Câu|Khối) (này|văn này|chữ này) (chỉ để|dùng để|để) (lấp chỗ trống|thử bố cục|giữ chỗ|kiểm tra phông chữ|điền trang).
(El texto|La nota|El pie de foto|El informe|El resumen) (llegará|aparecerá|vendrá|se pondrá|se subirá) (tras la revisión|después de la sesión|cuando el editor termine|en la próxima versión|la semana próxima).
(Este párrafo|Esta línea|Este bloque|Esta frase) (solo|únicamente) (ocupa|llena|rellena|reserva) (espacio|el hueco|la página|el lugar)( del diseño| por ahora| hasta tener el texto|).
"""

FRAME = r"""
(Home|Start|Main page|Homepage)( / | > | › | · | - )(About|Contact|Search|News|Products|Gallery|Services|Blog|Archive|Documents|Help)( / | > | › | · | - )(Login|Log in|Sign up|Register|FAQ|Sitemap|Help|Settings|Profile)
(Skip to|Jump to|Go to|Back to|Return to) (content|main content|navigation|top|top of page|the list|overview|search results)
(Menu|Navigation|Search|Login|Log out|Share|Print|Next|Previous|Older posts|Newer posts|Read more|Show more|Close|Cancel|Submit|OK|Download|Upload)
(Copyright|©|(c)) (2000|0000|2000-0000)( |, )(All rights reserved|the company|the authors|the project)(.|)
(Privacy policy|Terms of use|Terms and conditions|Imprint|Legal notice|Contact us|About us|Site map|Accessibility)
(Page|Slide|Sheet|Part|Chapter|Step|Section) (0|00|0 of 0|00 of 00|0/0)
(Follow us on|Share this on|Find us on) (Facebook|Twitter|Instagram|social media)
(Posted|Published|Updated|Last updated|Last modified|Created)( on| by|:) (Monday|0000-00-00|00/00/0000|admin|editor)
(Trang chủ|Giới thiệu|Liên hệ|Đăng nhập|Đăng ký|Tìm kiếm|Tin tức|Trợ giúp|Quay lại|Trang trước|Trang sau|Chia sẻ|Bản quyền|Danh mục)
(Inicio|Contacto|Acerca de|Buscar|Entrar|Registro|Ayuda|Noticias|Volver|Anterior|Siguiente|Compartir|Imprimir|Todos los derechos reservados|Aviso legal)
"""

MENTIONS = r"""
(The|Our|Each|This|That|Every) (form|template|exporter|script|manual|guide|letter|editor|page|system|macro|mail merge) (uses|fills|replaces|shows|prints|expects|writes|has|contains|inserts|knows) (X|the field X|the placeholder X|the token X|the variable X|X as its merge field|the tag X) (and|before|when|for|in|as|where) (the name|fills it before saving|the letter is sent|the record is saved|it is exported|the value of the owner|every sheet|each row).
(The|A) (placeholder|field|token|variable|tag|merge field|marker|column|parameter|key|expression) X (stands for|is replaced by|is filled with|means|holds|marks|names|refers to|expands to|becomes|is written as) (the name|the owner|the value|the date|the number|the text|the class|the path).
(Write|Use|Type|Replace|Do not leave|Never leave|Avoid|Search for|Look for|Check for|Remove) X (where|when|in|as|before|instead of|with) (the name|the template|the text|a value|sending|publishing|the form|needed|the real value).
(Class names|Labels|Names|Keys|File names|Paths|Columns|Rows|Entries) (are|were|is) (written|stored|built|given|formatted|named|encoded) as X( in every sheet| for each record| in the table| by convention|).
(In|Inside) (the template|the config|the code|the manual|the example|the query|the script|templates), X (is|means|marks|stands for|refers to|denotes|gets) (replaced|the name|a variable|a field|the current value|the row number|the path).
(Reviewers|Editors|Authors|We|They|Users|Labellers|Operators) (never|always|often|must|should|sometimes|found that|know that|saw|reported) (leave|replace|fill|use|see|write|find|mistake|type|remove) X (in the column|in the text|by hand|before saving|in old letters|for a name|as a value|when they copy the form).
(Trường|Ký hiệu|Biến|Mẫu|Chỗ|Cột) X (được thay bằng|là|dùng để|nghĩa là|được điền|thay cho|sẽ được thay bằng|chỉ) (tên|giá trị|ngày|số lô|chủ sở hữu|tên người chụp|đường dẫn).
(Biểu mẫu|Mẫu thư|Phần mềm|Hướng dẫn|Người duyệt) (dùng|thay|điền|giải thích|không để|có) X (trước khi lưu|thay cho tên|trong cột|khi xuất|làm trường trộn thư|ở mỗi dòng).
(El campo|La variable|El marcador|La etiqueta|La plantilla|El formulario) X (se sustituye por|significa|se rellena con|indica|representa|equivale a|contiene) (el nombre|el valor|la fecha|el número|el dueño|la ruta).
(La plantilla|El manual|El formulario|El programa|La guía) (usa|sustituye|rellena|explica|muestra|emplea) X (antes de guardar|en lugar del nombre|como campo|en cada fila|al exportar|para el nombre).
(It|This|The value|The key|The name|The date|The owner|A missing value|The record) (is|was|gets) (shown as|written as|called|named|given as|marked as|printed as|stored as|encoded as|rendered as) X( in the export| in the file| in the old sheets| by the tool|).
(The|A|Any) (literal|string|text|pattern|syntax|format|notation|marker|sequence|snippet|expression) X (appears|stands|is used|is allowed|is reserved|is kept|is ignored|is matched|means|is legal|is searched for) (in the template|in the source|by the parser|as it is|in the log|for names|by the script).
(Rows|Records|Letters|Files|Texts|Sheets|Notes|Mails) (with|that hold|that contain|still holding|that keep) X (are|were|must be|should be|get) (rejected|sent back|fixed|flagged|filtered|counted|not sent|skipped by the importer).
(For example|For instance|Such as|Like|That is|As in|E.g.)(,|) X (is replaced|becomes|would be|is filled|turns into|is read|stands for|is) (by the name|the name|with the value|a field|the lot number|on export).
(Curly braces|Square brackets|Angle brackets|Double braces|Underscores|Percent signs|Brackets|Braces) (as in X|such as X|like X|around a word, X,) (mark|show|mean|denote|delimit|enclose|set off) (a field|a variable|a placeholder|what the program fills in|optional words|the tags).
(The|Our) (style guide|documentation|readme|manual|handbook|checklist|lesson|training note|policy|tutorial) (says|explains|describes|shows|notes|warns|lists) (that|how|why|when) X (is used|is filled|must be replaced|stands for the name|works|should not remain|may appear).
(How|Why|When|Where) (to|do we|should one|does the tool) (use|fill|replace|write|find|escape|quote) X( in a template| in the forms| correctly| before printing|)(?|.|:)
(Tools|Scripts|Programs|Templates|Forms|Exporters|Importers|Editors|Macros|Engines) (that|which|can|will|may) (read|write|fill|replace|understand|print|expand|use|leave) X (as a field|as a name|by the current value|at run time|in each copy|when the job runs).
(Người ta|Chúng tôi|Tài liệu|Hướng dẫn|Ví dụ|Công cụ|Phần mềm) (viết|dùng|gọi|ghi|giải thích|thay|đánh dấu) (cú pháp|ký hiệu|trường|biến|chuỗi|dạng|thẻ) X (để|cho|khi|thay cho|trong|là) (chỉ tên|giá trị|mẫu thư|xuất tệp|bảng|một trường trống|tự điền).
(Dòng|Thư|Bản ghi|Tệp) (còn|có|chứa) X (bị trả lại|sẽ bị lọc|phải sửa|không được gửi|được đánh dấu).
(La sintaxis|La cadena|El patrón|La expresión|El texto|La marca|La clave) X (se usa|se escribe|aparece|indica|significa|está reservada|se reemplaza|se interpreta) (en las plantillas|en el código|para nombres|al exportar|como campo|como variable|por el valor).
(Las filas|Las cartas|Los registros|Los textos|Las hojas) (con|que contienen|que aún tienen) X (se rechazan|se devuelven|se corrigen|se filtran|no se envían|se marcan).
(Por ejemplo|Así|Es decir)(,|) X (se sustituye por|pasa a ser|se lee como|equivale a|se rellena con) (el nombre|la fecha|el valor|el lote).
"""

LEFT = r"""
(Dear|Hello|Hi|Hey|Attention|To|Mr|Ms) X(,|:|!|.) (thank you for your message|your order has arrived|we have received your letter|please find attached|your parcel was sent|this is to inform you)
(Name|Date|Address|Owner|Author|Signed|Reviewer|Place|Phone|Email|Number|Weight|Subject|Lot|Order|Amount|Title|Customer|Operator|Signature|Approved by|Checked by|Received by|Contact|Reference|Price|Quantity|Total|Location|Device)(:| :|: |) X
(It|This|The item|The sample|The box|The parcel|The photo|The file|The record|The lot|The order) (belongs to|was taken by|was checked by|was sent to|was received on|was signed by|weighs|comes from|is kept at|was reviewed by|arrived on|was stored in|is assigned to) X(.| on X.| and X.| at X.|)
(Signed|Approved|Checked|Written|Prepared|Taken|Sent|Received|Delivered|Reviewed|Stored) (by|on|at|for|to|from|in) X(.|,|)
(Best regards|Sincerely|Kind regards|Yours|Thanks|Regards)(,|) X
(We|I|They|The team) (met|thank|visited|asked|told|called|informed|paid) X (on X|at X|yesterday|about the order|for the help|in the office|last week).
(Thank you|Thanks|Welcome|Congratulations)(,|) X(!|.|, your request was received.|, we will call you.)
(Between|From) X (and|to) X(,|.|) (the|a) (parties|temperature|weight|trip|period|lot) (agree|rose|was|lasted|changed)
(Kính gửi|Chào|Xin chào|Gửi|Thân gửi) X(,|:|.)
(Họ tên|Ngày|Địa chỉ|Người chụp|Người duyệt|Số lô|Chủ|Ký tên|Điện thoại|Nơi nhận|Khối lượng|Tên)(:|: | là ) X
(Mẫu|Lô|Ảnh|Khay|Thùng) (này |)(thuộc về|do|được chụp bởi|được kiểm tra bởi|gửi cho|nhận ngày|nặng|lưu tại) X(.| chụp.|)
(Estimado|Estimada|Hola|Señor|Señora) X(,|:|.)
(Nombre|Fecha|Dirección|Autor|Revisor|Firma|Teléfono|Lote|Dueño|Lugar|Peso|Número)(:|: ) X
(La muestra|El lote|La foto|La caja|La bandeja) (pertenece a|fue revisada por|fue tomada por|llegó el|pesa|se guarda en|se envió a|se recibió el) X(.|)
(The|This|Our) (lot|tray|box|crate|sample|batch|order|photo|session|record|shipment) (X|of X|from X|for X|number X) (was|is|has been|will be) (photographed|stored|weighed|checked|received|sent|moved|reviewed|delivered|accepted)( on X| by X| at X| in X|).
(Your|The) (reference|order number|appointment|password|user name|code|invoice|delivery|balance|contact) (is|will be|has been set to|was) X(.|, please keep it.|)
(On|At|In|By|Since|Until|From) X(,|) (we|the team|the labeller|the reviewer|the grower|the courier) (received|checked|took|weighed|sent|stored|signed|picked up) (the|a|your) (box|tray|sample|order|photo|letter|lot).
(Ngày|Lúc|Tại|Bởi) X(,|) (chúng tôi|nhóm|người chụp|người duyệt) (đã nhận|đã kiểm tra|đã chụp|đã gửi|đã cân) (lô|khay|mẫu|thùng|đơn hàng|ảnh).
(El|Con fecha|Desde) X(,|) (recibimos|el equipo revisó|el revisor pesó|enviamos|se guardó|se firmó) (la caja|la bandeja|el lote|la muestra|el pedido|la foto).
"""


# Natural prose of no special domain: what is common in any text is no sign of residue, however small the corpus.
PROSE = r"""
(The|Our|A|One|Another|Each|That|This) (old|small|large|green|first|second|last|quiet|heavy|bright|wooden|cold|fresh|brown|ripe|wet) (house|river|garden|kitchen|market|table|tree|box|shelf|room|road|window|field|boat|letter|fruit|apple|crate) (was|stood|lay|looked|seemed|had been|turned|stayed|kept) (empty|near the door|on the left side|behind the wall|under the lamp|in the shade|brown near the edge|soft after two days|dry in the sun|clean and firm) (in the morning|after the rain|before noon|for a week|when we arrived|during the night|since Monday|at the end of the day).
(We|They|She|He|My neighbour|The farmer|The teacher|The driver|Two workers|The children|Our team) (walked|carried|measured|weighed|bought|sold|moved|cleaned|packed|watched|collected|sorted|photographed|counted|painted) (the|some|three|twelve|several|most of the|a few|about ten) (apples|boxes|chairs|stones|letters|trays|plants|books|bottles|bags|oranges|leaves|pictures|samples) (from|to|in|near|behind|across|along|beside|into|under) (the barn|the station|the upper shelf|the river|the cold room|the house|the road|the school|the scale|the packing hall).
(When|After|Because|Although|While|Since|Before|If) (the rain stopped|the day was warm|it was late|the light was weak|the road was closed|the train had left|the harvest began|the water was cold)(,|) (we|they|the others|the men|everyone|the buyers) (went home|waited inside|kept the lamp on|started again|took the long way|lost about 30 grams|shared the bread|closed the gate).
(There|Here) (were|was|is|are) (a small crack|two dark spots|some dust|little mould|a thin line|no wind|a smell of smoke|many birds|several dents) (on|near|along|around|below|above) (the skin|the stem|the lower half|the rim|the roof|the window|the surface|the label|the corner)(, and|, but|;) (it|nothing|the rest|the colour|the shape) (stayed|changed|grew|looked the same|could be seen from far away|was clear by noon).
(The|Their|Her|His|My) (mother|brother|friend|doctor|captain|reader|grower|reviewer|colleague|photographer) (said|wrote|noted|thought|told us|remembered|believed|found|reported|explained) that (the weather would change|the price had gone up|the road was long|the photograph was blurred|the second sample was firmer|the wood had dried|the summer had been short|the weight card was correct|the meal was good).
(In|During|Until|Towards|Through|Over) (spring|the winter|that year|the second week|the afternoon|the early hours|March|the long summer) (the|our|most|all|many) (days|fields|shops|roads|trees|rows|trips|nights) (were|grew|became|remained|looked) (longer|quiet|busy|green|covered with snow|warm enough|crowded|easy to pass).
(A|The) (report|book|map|story|chapter|drawing|table|diagram) (about|of|on) (the village|the coast|old tools|fruit storage|bread|the weather|migrating birds|paper making) (describes|shows|compares|contains|covers|begins with) (how people lived|the four seasons|prices and weights|the use of ice|three kinds of wood|the names of places|every step of the work).
(It|This) (takes|took|needs|cost|lasted) (about|nearly|more than|less than|only) (two hours|ten days|a month|three coins|half a year|one bucket of water) to (dry|cross|build|cool|ripen|finish|learn|repair|fill) (the grain|the valley|a wall|the fruit|the work|the craft|the engine|the tank).
(Người|Ông|Bà|Chị|Anh|Cô giáo|Bác nông dân|Hai người thợ|Trẻ em|Nhóm chúng tôi) (chụp ảnh|bán hàng|hàng xóm|lái xe|làm vườn|) (đã|vừa|thường|đang|sẽ) (mang|cân|chụp|xếp|mua|bán|đếm|rửa|gói|trồng|đo) (vài quả|hai thùng|nhiều cây|một rổ|mấy khay|ba quả|những quyển sách) (táo|cam|chuối|cà chua|rau|gạo|hoa) (ở|trong|ngoài|gần|sau|trên|dưới) (chợ|kho lạnh|vườn|nhà|bờ sông|kệ trên|trường học|ánh đèn)(.| vào buổi sáng.| sau hai ngày.| khi trời mưa.)
(Vỏ|Cuống|Mặt dưới|Phần vai|Lá|Quả|Thân cây) (quả táo|quả cam|quả chuối|của mẫu|bên trái|thứ hai|này) (còn|đã|hơi|vẫn|bắt đầu) (bóng|mềm|khô|thâm|xanh|chuyển nâu|có vết nứt nhỏ|nhăn|cứng) (sau một tuần|dưới đèn trần|khi để ngoài nắng|nhưng mùi vẫn thơm|và nặng khoảng 200 gram|vì kho ấm lên).
(Buổi sáng|Mùa hè|Hôm qua|Năm ngoái|Trong tuần|Sau cơn mưa) (trời|con đường|dòng sông|chợ|ngôi làng|cánh đồng) (rất|khá|hơi|lại|không còn) (lạnh|đông người|yên tĩnh|xanh|dài|vắng|ấm) (nên|và|nhưng) (mọi người|chúng tôi|họ|đàn chim) (về sớm|nghỉ trong nhà|đi chậm lại|vẫn làm việc|bay về phía nam).
(El|Un|Nuestro|Aquel|Cada) (vecino|agricultor|maestro|conductor|fotógrafo|amigo|trabajador|revisor) (llevó|pesó|compró|vendió|midió|contó|limpió|fotografió|guardó|recogió) (las|unas|tres|varias|doce|algunas) (manzanas|naranjas|cajas|cartas|plantas|bandejas|piedras|sillas|muestras) (en|cerca de|detrás de|desde|hasta|junto a) (la casa|la estación|el río|la cámara fría|el mercado|la escuela|el estante|la ventana)(.| por la mañana.| después de la lluvia.| durante la semana.)
(La|Una|Esta|Aquella) (piel|parte inferior|fruta|habitación|calle|mesa|pieza|etiqueta|hoja) (estaba|parecía|quedó|seguía|se puso) (blanda|firme|seca|marrón|vacía|limpia|verde|fría) (cerca del tallo|a los dos días|bajo la lámpara|por la tarde|desde el lunes|al final del día) (y|pero|aunque) (perdió unos gramos|el color no cambió|nadie lo vio|el olor era bueno|pesaba lo mismo).
(Cuando|Aunque|Porque|Mientras|Antes de que) (llovía|hacía frío|el día era largo|faltaba luz|el camino estaba cerrado) (nosotros|ellos|los niños|las mujeres|los demás) (volvimos a casa|esperaron dentro|siguieron el trabajo|tomaron otro camino|compartieron el pan).
"""


def mock_latin(count: int = LATIN) -> list[list[str]]:
    """Sentences of invented Latin-like words: beginnings, vowels, codas and endings joined at random."""
    draw = random.Random("mock Latin")
    begin = ["", "b", "c", "d", "f", "g", "l", "m", "n", "p", "qu", "r", "s", "t", "v", "tr", "pr", "cr", "fr", "gr", "pl", "cl", "st", "sp", "h", "j"]
    vowel = ["a", "e", "i", "o", "u", "a", "e", "i", "ae", "au"]
    coda = ["", "", "n", "m", "r", "s", "l", "nt", "nd", "st", "x", "c"]
    end = ["um", "us", "is", "am", "em", "it", "at", "unt", "ant", "ibus", "orum", "endo", "iter", "ur", "o", "a", "e", "as", "os", "ere", "isse", "ens"]

    def word() -> str:
        return "".join(draw.choice(begin) + draw.choice(vowel) + draw.choice(coda) for _ in range(draw.choice([0, 1, 1, 1, 2]))) + draw.choice(begin) + draw.choice(end)

    return [[" ".join(word() for _ in range(draw.randint(6, 12))).capitalize() + "."] for _ in range(count)]


def phrases(text: str) -> list[list[str]]:
    """The phrases drawn from each template, without repeats; the draw depends on the template alone."""
    out, size = [], 0
    for line in filter(None, (x.strip() for x in text.splitlines())):
        draw = random.Random(line)
        made = dict.fromkeys(CHOICE.sub(lambda m: draw.choice(m[1].split("|")), line) for _ in range(DRAWN))
        out.append(list(made)[: max(0, LIMIT - size)])
        size += len(out[-1])
    return out
