"""Names, markers, labels and weights that results must carry exactly. Plain data, no logic."""

# Order of rules: the first that matches names the category.
STRING_RULES = (
    ("url", ("prefix", ("http://", "https://"))),
    ("command", ("contains", ("powershell", "cmd.exe", "/bin/sh", "curl ", "wget "))),
    ("credential_hint", ("contains", ("password", "passwd", "token", "apikey", "api_key", "secret"))),
    ("platform_indicator", ("suffix", (".dll", ".exe", ".sys"))),
    ("platform_indicator", ("contains", ("\\software\\",))),
)
STRING_BEHAVIOR = {"url": ("network", "medium"), "command": ("process_execution", "medium"), "credential_hint": ("credential_access", "medium"), "platform_indicator": ("filesystem", "low")}
OTHER_STRING_BEHAVIOR = ("string_indicator", "low")

API_SUFFIXES = ("", "a", "w", "ex", "exa", "exw", "2", "2a", "2w")
API_RULES = (
    ("process_injection", "high", "process memory/thread manipulation API", "createremotethread ntcreatethreadex writeprocessmemory readprocessmemory virtualallocex openprocess setthreadcontext queueuserapc"),
    ("network", "medium", "network communication API", "internetopen internetconnect internetopenurl httpopenrequest httpsendrequest winhttpopen winhttpconnect winhttpsendrequest wsastartup connect send recv urldownloadtofile"),
    ("registry", "medium", "Windows registry access API", "regopenkey regcreatekey regsetvalue regqueryvalue regdeletekey regdeletevalue"),
    ("process_execution", "medium", "process execution/control API", "createprocess shellexecute winexec system terminateprocess"),
    ("filesystem", "medium", "file access or filesystem API", "createfile readfile writefile deletefile movefile copyfile findfirstfile findnextfile getfileattributes setfileattributes"),
    ("memory", "medium", "memory allocation/protection API", "virtualalloc virtualprotect heapalloc rtlmovememory rtlcopymemory"),
    ("dynamic_loading", "medium", "runtime library loading or symbol lookup API", "loadlibrary getprocaddress ldrloaddll"),
    ("anti_debug", "medium", "debugger detection API", "isdebuggerpresent checkremotedebuggerpresent outputdebugstring ntqueryinformationprocess"),
    ("crypto", "medium", "cryptography or protected-data API", "cryptacquirecontext cryptprotectdata cryptdecrypt cryptencrypt bcrypt openssl"),
    ("persistence", "high", "service or scheduled-task persistence API", "createservice openservice startservice changeserviceconfig schtasks"),
)
SEVERITY_RANK = {"high": 3, "medium": 2, "low": 1}
SEVERITY_WEIGHT = {"high": 35, "medium": 8, "low": 2}
RISK_LEVELS = (("high", 70), ("medium", 25), ("low", 1))

# family, display name, guidance
RUNTIME_FAMILIES = (
    ("python_packaged", "Python packaged executable", "Try extracting embedded archives and decompiling recovered .pyc files; native Nuitka/Cython output falls back to native analysis."),
    ("python_native", "Python native/embedded runtime", "Python runtime is present, but source recovery depends on whether bytecode or packaged modules remain embedded."),
    ("dart_flutter", "Dart/Flutter AOT", "Dart/Flutter release builds are usually AOT native code; recover metadata, strings, and native pseudocode rather than exact Dart source."),
    ("dotnet_clr", ".NET CLR", ".NET keeps IL and metadata; prefer CLR metadata/IL decompilation before native pseudocode."),
    ("go", "Go native binary", "Go is native code but often preserves pclntab/buildinfo for function names and richer call graph recovery."),
    ("rust", "Rust native binary", "Rust is native code; use symbol remnants, panic paths, strings, and native decompilation rather than expecting source recovery."),
    ("electron_node", "Electron/Node packaged app", "Look for app.asar/resources and JavaScript assets before treating the executable as only native code."),
    ("jvm", "JVM/Java packaged app", "JVM packaging may contain class/JAR content; prefer bytecode decompilation when classes can be extracted."),
)
# family, order inside the family, where to look, needle, label. "string" looks into strings and section bytes.
RUNTIME_MARKERS = (
    ("python_packaged", 0, "string", "PYZ-00.pyz", "PyInstaller PYZ archive"),
    ("python_packaged", 1, "string", "_MEIPASS", "PyInstaller temp extraction marker"),
    ("python_packaged", 2, "string", "pyi_rth", "PyInstaller runtime hook"),
    ("python_packaged", 3, "string", "__nuitka", "Nuitka marker"),
    ("python_packaged", 4, "string", "Nuitka", "Nuitka marker"),
    ("python_packaged", 5, "import", "python", "imports Python runtime library"),
    ("python_native", 0, "import", "python", "imports Python runtime library"),
    ("python_native", 1, "function", "Py_Initialize", "imports Py_Initialize"),
    ("python_native", 2, "function", "PyImport_", "imports PyImport API"),
    ("python_native", 3, "string", "Py_Initialize", "CPython embedding API"),
    ("python_native", 4, "string", "PyImport_", "CPython import API"),
    ("dart_flutter", 0, "section", "vm_snapshot", "Dart VM snapshot section"),
    ("dart_flutter", 1, "section", "isolate_snapshot", "Dart isolate snapshot section"),
    ("dart_flutter", 2, "string", "Flutter", "Flutter marker"),
    ("dart_flutter", 3, "string", "Dart VM", "Dart VM marker"),
    ("dart_flutter", 4, "string", "dart:ui", "Flutter dart:ui library"),
    ("dart_flutter", 5, "string", "_kDartIsolateSnapshotInstructions", "Dart AOT snapshot symbol"),
    ("dotnet_clr", 0, "import", "mscoree", "imports mscoree.dll"),
    ("dotnet_clr", 1, "function", "_CorExeMain", "imports _CorExeMain"),
    ("dotnet_clr", 2, "string", "BSJB", ".NET metadata signature"),
    ("dotnet_clr", 3, "string", "#~", ".NET metadata stream"),
    ("go", 0, "section", ".gopclntab", "Go pclntab section"),
    ("go", 1, "section", "go.buildinfo", "Go build info section"),
    ("go", 2, "string", "Go build ID:", "Go build id"),
    ("go", 3, "string", "runtime.gopanic", "Go runtime symbol"),
    ("go", 4, "string", "runtime.main", "Go runtime symbol"),
    ("rust", 0, "string", "core::panicking", "Rust panic path"),
    ("rust", 1, "string", "rust_panic", "Rust panic symbol"),
    ("rust", 2, "string", "rust_begin_unwind", "Rust unwind symbol"),
    ("rust", 3, "string", "std::rt::lang_start", "Rust runtime entry"),
    ("electron_node", 0, "import", "node", "imports Node runtime library"),
    ("electron_node", 1, "string", "Electron", "Electron marker"),
    ("electron_node", 2, "string", "app.asar", "Electron asar archive"),
    ("electron_node", 3, "string", "node_modules", "Node package tree"),
    ("electron_node", 4, "string", "resources/app", "Electron resources path"),
    ("jvm", 0, "string", "java/lang/Object", "JVM class reference"),
    ("jvm", 1, "string", "META-INF/MANIFEST.MF", "JAR manifest"),
    ("jvm", 2, "string", "Launch4j", "Java exe wrapper"),
    ("jvm", 3, "import", "jvm", "imports JVM runtime library"),
)
#: Counts for its family only beside another marker.
WEAK_MARKER = ("dotnet_clr", "#~")

# signal, confidence, reason, recipe as compact JSON
RECIPES = {
    "url_percent_encoding": (85, "contains repeated %HH escape sequences", '[{"op":"URL Decode","args":[true]}]'),
    "hex": (80, "long even-length hexadecimal string", '[{"op":"From Hex","args":["Auto"]}]'),
    "escaped_hex": (75, "contains repeated \\xHH byte escapes", '[{"op":"Unescape string","args":[]}]'),
}
BASE64_REASONS = {"H4sI": "base64 text starts with a common gzip marker", "eJ": "base64 text starts with a common zlib marker", "": "long padded base64-looking string"}
BASE64_MORE = {"H4sI": ',{"op":"Gunzip","args":[]}', "eJ": ',{"op":"Zlib Inflate","args":[0,0,"Adaptive",false,false]}', "": ""}
LINK_BASE = "https://gchq.github.io/CyberChef/#recipe="

C_KEYWORDS = (
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static"
    " struct switch typedef union unsigned void volatile while _Alignas _Alignof _Atomic _Bool _Complex _Generic _Imaginary _Noreturn _Static_assert _Thread_local"
    " alignas alignof bool false nullptr static_assert thread_local true typeof typeof_unqual NULL"
)
# 64-bit name of a general register -> its parts
REGISTERS = {
    "rax": "al ah ax eax", "rbx": "bl bh bx ebx", "rcx": "cl ch cx ecx", "rdx": "dl dh dx edx", "rsi": "sil si esi", "rdi": "dil di edi", "rbp": "bpl bp ebp", "rsp": "spl sp esp",
} | {f"r{n}": f"r{n}b r{n}w r{n}d" for n in range(8, 16)}
CONDITIONS = {
    "==": "je jz", "!=": "jne jnz", "<": "jl jnge jb jnae jc", "<=": "jle jng jbe jna", ">": "jg jnle ja jnbe", ">=": "jge jnl jae jnb jnc",
}
ARGUMENT_REGISTERS = {"PE/EXE": ("rcx", "rdx", "r8", "r9"), "ELF": ("rdi", "rsi", "rdx", "rcx", "r8", "r9"), "Mach-O": ("rdi", "rsi", "rdx", "rcx", "r8", "r9")}
PROLOGUES = {"x86": ("558bec",), "x64": ("554889e5", "f30f1efa", "4883ec", "4881ec"), "ARM": ("70b5",), "ARM64": ("fd0300a9", "ff4300d1")}
ARM_CONDITIONS = "eq ne cs hs cc lo mi pl vs vc hi ls ge lt gt le"
PE_DIRECTORIES = (
    "export_table import_table resource_table exception_table certificate_table base_relocation_table debug_table architecture global_ptr tls_table load_config_table bound_import_table"
    " import_address_table delay_import_descriptor clr_runtime_header"
)

# Runtime reports: family, summary, what its artifacts are (evidence with a detail, or none), actions (label, detail)
RUNTIME_REPORTS = (
    ("python_packaged", "Python packaged executable: for PyInstaller-style bundles attempt archive extraction first, then bytecode recovery when .pyc payloads are present.", "", (
        ("Extract embedded Python archive", "Look for PyInstaller CArchive/PYZ payloads and recover bundled modules before native C pseudocode."),
        ("Decompile bytecode when available", "Recovered .pyc files can often be decompiled back to Python-like source; Nuitka/Cython builds usually require native analysis instead."),
    )),
    ("python_native", "Embedded CPython runtime detected: source recovery depends on whether bytecode/modules are embedded or loaded externally.", "Runtime evidence", (
        ("Inspect module loading paths", "Trace PyImport/Py_Initialize usage to find embedded modules, external paths, or encrypted loaders."),
        ("Prefer bytecode recovery if present", "If .pyc payloads exist, decompile bytecode; otherwise continue with native pseudocode around the embedding API."),
    )),
    ("dart_flutter", "Dart/Flutter AOT binary: release builds are native snapshots, so exact Dart source recovery is not expected.", "", (
        ("Inventory snapshots and Flutter markers", "Report vm/isolate snapshot sections, dart:ui strings, and Flutter metadata before native decompilation."),
        ("Use native pseudocode fallback", "Recover control flow, strings, and API usage; this is not exact Dart source reconstruction for AOT release builds."),
    )),
    ("dotnet_clr", ".NET CLR binary: IL and metadata should be analyzed before treating it as opaque native code.", "CLR evidence", (
        ("Prefer IL decompilation", "Extract CLR metadata/IL and inspect it with dnSpy or ILSpy."),
        ("Use native fallback only for mixed-mode code", "Native pseudocode is still useful for unmanaged stubs, packed loaders, or mixed-mode components."),
    )),
    ("go", "Go native binary: recover function names and call graph from preserved runtime metadata when possible.", "", (
        ("Recover Go metadata", "Parse pclntab/buildinfo to improve function names before emitting native pseudocode."),
    )),
    ("rust", "Rust native binary: use panic paths, symbol remnants, and strings to improve native decompilation context.", "Rust evidence", (
        ("Annotate Rust runtime evidence", "Use core/std panic markers and any demangled symbols to label functions before native pseudocode."),
    )),
    ("electron_node", "Electron/Node packaged app: JavaScript assets may be recoverable separately from the native wrapper.", "", (
        ("Extract application assets", "Look for app.asar/resources and recover JavaScript/TypeScript assets before native wrapper analysis."),
    )),
    ("jvm", "JVM packaged app: class or JAR content may be recoverable and decompiled as bytecode.", "JVM evidence", (
        ("Extract JVM bytecode", "Search for class/JAR resources and decompile bytecode before native launcher analysis."),
    )),
)
# family, where to look, needle, detail
REPORT_MARKERS = (
    ("python_packaged", "string", "PYZ", "PyInstaller archive marker"),
    ("python_packaged", "string", "_MEIPASS", "PyInstaller extraction directory marker"),
    ("python_packaged", "string", "pyi_rth", "PyInstaller runtime hook"),
    ("python_packaged", "string", "Nuitka", "Nuitka native Python marker"),
    ("dart_flutter", "section", "snapshot", "Dart/Flutter snapshot-related section"),
    ("dart_flutter", "string", "dart:ui", "Flutter dart:ui marker"),
    ("dart_flutter", "string", "Flutter", "Flutter marker"),
    ("go", "section", "gopclntab", "Go metadata section"),
    ("go", "section", "go.buildinfo", "Go metadata section"),
    ("electron_node", "string", "app.asar", "Electron application archive"),
    ("electron_node", "string", "node_modules", "Node package directory"),
)
# name, pattern over "; "-joined instructions, confidence
CODE_PATTERNS = (
    ("function_prologue_x86", r"push (ebp|rbp);\s*mov (ebp|rbp), (esp|rsp)", 0.9),
    ("function_prologue_x64", r"push rbp;\s*mov rbp, rsp", 0.9),
    ("string_copy", r"mov (eax|rax),\s*\[.*\];\s*test (eax|rax),\s*(eax|rax)", 0.7),
    ("for_loop", r"dec (eax|ecx|rcx);\s*jnz", 0.8),
    ("while_loop", r"cmp.*;\s*j[ne|ge|le]", 0.7),
    ("malloc_call", r"call.*malloc", 0.95),
    ("free_call", r"call.*free", 0.95),
)
# type, C name, bytes; an array has its element's name with [] and its element's bytes times its length
C_TYPES = (
    ("Void", "void", 0), ("Bool", "bool", 1), ("I8", "int8_t", 1), ("U8", "uint8_t", 1), ("I16", "int16_t", 2), ("U16", "uint16_t", 2), ("I32", "int32_t", 4), ("U32", "uint32_t", 4),
    ("I64", "int64_t", 8), ("U64", "uint64_t", 8), ("Pointer(Void)", "void*", 8), ("Pointer(I8)", "char*", 8), ("Pointer(U8)", "unsigned char*", 8), ("FunctionPointer", "void(*)()", 8), ("Unknown", "void*", 8),
)
