"""Names of languages that code blocks are written in."""

#: Common names and short names of code languages.
CODE_LANGUAGES = frozenset(
    """ada apache asm awk bash bat c c++ clojure cmake cobol console cpp cs csharp css csv d d2 dart diff docker dockerfile
    dot elixir elm erlang f# fish fortran fsharp gherkin gitignore go graphql graphviz groovy haskell hcl html http ini
    java javascript js json json5 jsonc jsx julia kotlin latex less lisp lua make makefile markdown math matlab md mermaid
    nim nginx nix objective-c ocaml pascal patch perl php plaintext powershell prolog properties protobuf ps1 py python r
    rb regex rs ruby rust scala scheme scss sh shell sol sql svelte svg swift tcl terraform tex text toml ts tsx txt
    typescript v vb verilog vhdl vim vue wasm wat xml yaml yml zig zsh
    abap actionscript antlr applescript astro avro ballerina bibtex bicep blade cfg clj cljs coffee coffeescript commonlisp coq crystal csh csx cuda cython
     delphi ejs erb gd gdscript gleam glsl gnuplot gradle gql h haml handlebars haxe hlsl hpp hx jinja jinja2 jsonl jsonnet lean liquid log mdx meson mips ml mysql octave odin org pgsql plantuml po postcss prisma purescript q rmd rst sass sed sml sv systemverilog thrift typst vala vhd wgsl xslt zeek""".split()
)
