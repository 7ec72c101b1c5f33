"""Which repositories and files are looked at."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extensions of text files.
TEXT_EXTENSIONS = (
    ".txt .text .md .markdown .rst .properties .prop .props .env .cfg .conf .config .ini .toml .yaml .yml .json .json5 .jsonc .xml .plist .csv .tsv .gradle .sbt .pom .lock "
    ".npmrc .yarnrc .pypirc .netrc .pem .key .crt .cer .pub .ppk .asc .gpg .kbx .sql .sh .bash .zsh .ksh .ps1 .psm1 .psd1 .bat .cmd .py .rb .pl .pm .php .js .cjs .mjs .ts "
    ".jsx .tsx .go .java .kt .kts .scala .clj .groovy .gvy .cs .vb .fs .c .h .cpp .hpp .cc .rs .swift .dart .lua .r .tf .tfvars .hcl .nomad .dockerfile .dockercfg "
    ".dockerignore .htpasswd .htaccess .pp .erb .j2 .jinja .tpl .template .tmpl .cnf .cf .service .desktop .reg .gitconfig .credentials .secret .secrets .vault .cred .pwd "
    ".pass .tpr"
).split()
#: Names of text files.
SPECIAL_NAMES = (
    "dockerfile containerfile .npmrc .yarnrc .yarnrc.yml .pypirc .netrc _netrc .git-credentials .gitconfig credentials config .env .env.local .env.prod .env.production "
    ".env.dev .env.development settings.xml web.config app.config application.properties application.yml application.yaml docker-compose.yml docker-compose.yaml "
    "compose.yml id_rsa id_dsa id_ecdsa id_ed25519 .htpasswd .dockercfg config.json .bash_history .bashrc .bash_profile .zshrc .profile terraform.tfstate secrets.yml "
    "secrets.yaml vault.yml vault.yaml .s3cfg .boto hub wp-config.php local.settings.json"
).split()
#: Extensions of archives.
ARCHIVE_EXTENSIONS = ".jar .war .ear .zip .aar .nupkg .whl .egg .gem .apk .tgz .tar .gz .crate".split()
#: Extensions that are never looked at.
SKIPPED_EXTENSIONS = (
    ".png .jpg .jpeg .gif .bmp .ico .webp .svg .mp3 .mp4 .avi .mov .mkv .flac .wav .woff .woff2 .ttf .eot .otf .pdf .doc .docx .xls .xlsx .ppt .pptx .iso .dmg .bin .so .dll "
    ".dylib .class .o .a .lib .obj .pyc .wasm .node .db .sqlite .mo"
).split()
#: Names of image manifests.
MANIFESTS = ["manifest.json", "list.manifest.json"]


def split_list(text: str) -> list[str]:
    """Items of a comma-separated list, trimmed, without blanks."""
    return [x.strip() for x in (text or "").split(",") if x.strip()]


@dataclass(frozen=True)
class RepoFilter:
    allow: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    package_type: str = ""
    include_remote: bool = False
    include_virtual: bool = False


def filter_repos(repos: DataFrame, f: RepoFilter = RepoFilter()) -> DataFrame:
    """Exclusion first; an allow list replaces the filter by type; package types (comma-separated) always count."""
    kind = F.upper("type")
    by_type = F.when(kind.isin("LOCAL", "FEDERATED"), True).when(kind == "REMOTE", f.include_remote).when(kind == "VIRTUAL", f.include_virtual).otherwise(f.include_remote or f.include_virtual)
    kept = F.col("key").isin(list(f.allow)) if f.allow else by_type
    if f.exclude:
        kept = kept & ~F.col("key").isin(list(f.exclude))
    if f.package_type:
        kept = kept & F.lower("package_type").isin([x.lower() for x in split_list(f.package_type)])
    return repos.where(F.coalesce(kept, F.lit(False)))


def listing_key(key: Column, type_: Column) -> Column:
    """Remote repositories are listed from their cache."""
    return F.when(F.upper(type_) == "REMOTE", F.concat(key, F.lit("-cache"))).otherwise(key)


@dataclass(frozen=True)
class FileFilter:
    extra_extensions: tuple[str, ...] = ()
    text_only: bool = True
    crack: bool = False
    no_files: bool = False
    images: bool = False

    @staticmethod
    def extensions(items: Iterable[str]) -> tuple[str, ...]:
        """Extra extensions in lower case, with their dot."""
        clean = [x.strip().lower() for x in items if x.strip()]
        return tuple(x if x.startswith(".") else f".{x}" for x in clean)


def base_and_extension(name: Column) -> tuple[Column, Column]:
    base = F.lower(F.element_at(F.split(name, "/"), -1))
    return base, F.when(base.contains("."), F.concat(F.lit("."), F.substring_index(base, ".", -1))).otherwise("")


def is_text(name: Column, f: FileFilter = FileFilter()) -> Column:
    base, ext = base_and_extension(name)
    return (
        F.when(ext.isin(SKIPPED_EXTENSIONS), False)
        .when(ext.isin(list(f.extra_extensions) or [" "]), True)
        .when(base.isin(SPECIAL_NAMES), True)
        .when(base.startswith(".env"), True)
        .when(ext.isin(TEXT_EXTENSIONS), True)
        .otherwise(F.lit(not f.text_only) & (ext == ""))
    )


def text_name(name: str, f: FileFilter = FileFilter()) -> bool:
    """is_text() of one name, for entries of archives."""
    base = name.rsplit("/", 1)[-1].lower()
    ext = "." + base.rsplit(".", 1)[-1] if "." in base else ""
    if ext in SKIPPED_EXTENSIONS:
        return False
    return ext in f.extra_extensions or base in SPECIAL_NAMES or base.startswith(".env") or ext in TEXT_EXTENSIONS or (not f.text_only and ext == "")


def is_manifest(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, "/"), -1)).isin(MANIFESTS)


def classify(name: Column, f: FileFilter = FileFilter()) -> Column:
    """Struct (scan, archive) for a listed file."""
    _, ext = base_and_extension(name)
    pair = lambda a, b: F.struct(a.alias("scan"), b.alias("archive"))
    no = F.lit(False)
    if f.no_files:
        return pair(is_manifest(name) if f.images else no, no)
    archive = pair(F.lit(f.crack), F.lit(f.crack))
    plain = pair(is_text(name, f) | (is_manifest(name) if f.images else no), no)
    return F.when(ext.isin(ARCHIVE_EXTENSIONS), archive).otherwise(plain)


def select_files(items: DataFrame, f: FileFilter = FileFilter(), max_size: int = 5 << 20, modified_after=None) -> DataFrame:
    """Listed files to be scanned, with a column archive. Names, sizes and times decide before any content is read.

    Files of unknown size stay, as reading cuts them; max_size 0 lets all sizes pass.
    """
    out = items
    if modified_after is not None:
        out = out.where(F.col("modified") > F.lit(modified_after))
    kind = classify(F.col("name"), f)
    out = out.withColumn("archive", kind["archive"]).where(kind["scan"])
    return out.where((F.coalesce("size", F.lit(0)) <= max_size) | F.col("archive")) if max_size > 0 else out


def shuffled(items: DataFrame, seed: int = 0) -> DataFrame:
    """Items in a random order that is the same on every run with the same seed."""
    return items.orderBy(F.xxhash64(F.lit(seed), "repo", "path", "name"), "repo", "path", "name")


def only_image_repos(items: DataFrame, image_repos: DataFrame) -> DataFrame:
    """Items of image repositories; all items if none are known."""
    if not image_repos.take(1):
        return items
    return items.join(image_repos.select(F.col("key").alias("repo")).distinct(), "repo", "left_semi")
