"""Reading tool outputs, source trees and datasets; writing datasets and reports."""
